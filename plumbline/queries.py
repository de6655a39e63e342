"""The catalogue: every operator as a query over the sample tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import HashPolicy, row_hash
from .functions.severity import AdaptiveRule, SeverityRule
from .operators import columns, counts, custom_sql, expectations, rows, sampling, stats
from .operators.counts import Rule
from .operators.stats import Metric, StatsCompare, StatsWindow
from .plans import loading, results
from .plans.config import CheckConfig, Partitions, TableConfig
from .sources.sides import Query, Source, latest_per_key

AS_OF = datetime(2024, 2, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perturbed(orders: DataFrame) -> DataFrame:
    """orders with missing, extra and changed rows."""
    changed = orders.where("o_orderkey % 97 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(F.col("o_orderkey") % 53 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")),
    })
    return changed.union(orders.where("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000))


TGT = """tgt AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders, perturbed(orders)


@query("SELECT count(*) AS source_count, count(*) AS target_count, 'PASS' AS status FROM orders")
def row_count_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return counts.row_count(orders, orders)


@query(f"WITH {TGT}, c AS (SELECT (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM tgt) AS target_count) SELECT *, CASE WHEN source_count = target_count THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def row_count_mismatch(spark, sf_dir):
    return counts.row_count(*sides(spark, sf_dir))


#: Chunks over the whole range of ids, however many.
WHOLE = sampling.Sampling("chunk", chunk_size=1000, max_scan_chunks=1 << 64)
CHUNKS = f"""{TGT}, b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM tgt)),
c AS (SELECT (o_orderkey - lo) // 1000 AS k, s FROM (SELECT o_orderkey, 1 AS s FROM orders UNION ALL SELECT o_orderkey, 0 FROM tgt), b),
g AS (SELECT k, CAST(sum(s) AS BIGINT) AS source_count, CAST(sum(1 - s) AS BIGINT) AS target_count FROM c GROUP BY k),
r AS (SELECT lo + k * 1000 AS range_start, least(hi, lo + k * 1000 + 999) AS range_end, source_count, target_count, source_count - target_count AS diff FROM g, b WHERE source_count <> target_count)"""


@query(f"WITH {CHUNKS} SELECT * FROM r")
def sample_chunk(spark, sf_dir):
    s, t = sides(spark, sf_dir)
    return sampling.mismatch_ranges(s, t, "o_orderkey", "o_orderkey", WHOLE).df


@query(f"WITH {CHUNKS} SELECT * FROM r ORDER BY abs(diff) DESC, range_start LIMIT 5")
def sample_chunk_top(spark, sf_dir):
    s, t = sides(spark, sf_dir)
    return sampling.mismatch_ranges(s, t, "o_orderkey", "o_orderkey", WHOLE).top(5)


@query(f"""WITH RECURSIVE {TGT}, b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM tgt)),
halves AS (
  SELECT lo, hi, 1 AS depth, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN lo AND hi) AS s, (SELECT count(*) FROM tgt WHERE o_orderkey BETWEEN lo AND hi) AS t FROM b
  UNION ALL
  SELECT x.lo, x.hi, x.depth, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN x.lo AND x.hi), (SELECT count(*) FROM tgt WHERE o_orderkey BETWEEN x.lo AND x.hi)
  FROM (SELECT CASE side WHEN 0 THEN lo ELSE (lo + hi) // 2 + 1 END AS lo, CASE side WHEN 0 THEN (lo + hi) // 2 ELSE hi END AS hi, depth + 1 AS depth
        FROM halves, (VALUES (0), (1)) v(side) WHERE s <> t AND depth < 5 AND lo < hi) x)
SELECT lo AS range_start, hi AS range_end, s AS source_count, t AS target_count, s - t AS diff FROM halves WHERE s <> t AND (depth = 5 OR lo = hi)""")
def sample_binary(spark, sf_dir):
    s, t = sides(spark, sf_dir)
    return sampling.mismatch_ranges(s, t, "o_orderkey", "o_orderkey", sampling.Sampling("binary", max_depth=5, max_scan_chunks=100)).df


@query(f"""WITH {TGT}, s AS (SELECT count(*) a, count(DISTINCT o_custkey) b, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) c, min(o_orderdate) d, max(o_orderpriority) e FROM orders),
t AS (SELECT count(*) a, count(DISTINCT o_custkey) b, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) c, min(o_orderdate) d, max(o_orderpriority) e FROM tgt)
SELECT 0 AS rule_idx, 'count' AS method, CAST(s.a AS DOUBLE) AS source, CAST(t.a AS DOUBLE) AS target, CAST(s.a = t.a AS BOOLEAN) AS pass FROM s, t
UNION ALL SELECT 1, 'distinct_count', s.b, t.b, s.b = t.b FROM s, t
UNION ALL SELECT 2, 'sum', s.c, t.c, abs(s.c - t.c) * 100 / greatest(abs(t.c), 1e-12) <= 1 OR s.c = t.c FROM s, t
UNION ALL SELECT 3, 'min', NULL, NULL, s.d = t.d FROM s, t
UNION ALL SELECT 4, 'max', NULL, NULL, trim(s.e) = trim(t.e) FROM s, t""")
def agg_rules(spark, sf_dir):
    price = "CAST(o_totalprice AS DECIMAL(18,2))"
    rules = [Rule("count"), Rule("distinct_count", "o_custkey", "o_custkey"), Rule("sum", price, price, tolerance_pct=1), Rule("min", "o_orderdate", "o_orderdate"), Rule("max", "o_orderpriority", "o_orderpriority")]
    return counts.aggregations(*sides(spark, sf_dir), rules).select("rule_idx", "method", "source", "target", "pass")


@query("""SELECT 0 AS rule_idx, 'max' AS method, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS source_text, strftime(max(o_orderdate) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS target_text, true AS pass FROM orders
UNION ALL SELECT 1, 'max', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S'), false FROM orders""")
def agg_datetime_tolerance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    late = "o_orderdate + INTERVAL 5 MINUTES"
    found = counts.aggregations(orders, orders, [Rule("max", "o_orderdate", late, tolerance_abs=5), Rule("max", "o_orderdate", late, tolerance_abs=4)])
    return found.select("rule_idx", "method", "source_text", "target_text", "pass")


@query(f"WITH {TGT} SELECT 0 AS rule_idx, 'avg' AS method, avg(o_custkey) AS source, (SELECT avg(o_custkey) FROM tgt) AS target, avg(o_custkey) = (SELECT avg(o_custkey) FROM tgt) AS pass FROM orders")
def agg_avg(spark, sf_dir):
    return counts.aggregations(*sides(spark, sf_dir), [Rule("avg", "o_custkey", "o_custkey")]).select("rule_idx", "method", "source", "target", "pass")


def _groups(aggregate: str, ok: str) -> str:
    return f"""WITH {TGT}, s AS (SELECT o_orderpriority AS p, CAST({aggregate} AS DOUBLE) AS v FROM orders GROUP BY 1), t AS (SELECT o_orderpriority AS p, CAST({aggregate} AS DOUBLE) AS v FROM tgt GROUP BY 1)
SELECT coalesce(s.p, t.p) AS p, s.v AS source, t.v AS target, coalesce({ok}, false) AS pass FROM s FULL JOIN t ON s.p IS NOT DISTINCT FROM t.p"""


@query(_groups("sum(CAST(o_totalprice AS DECIMAL(18,2)))", "s.v = t.v OR abs(s.v - t.v) * 100 / greatest(abs(t.v), 1e-12) <= 0.05"))
def group_agg_sum(spark, sf_dir):
    price = "CAST(o_totalprice AS DECIMAL(18,2))"
    return counts.group_aggregations(*sides(spark, sf_dir), [Rule("sum", price, price, tolerance_pct=0.05)], "o_orderpriority", "o_orderpriority").select("p", "source", "target", "pass")


@query(_groups("count(DISTINCT o_custkey)", "s.v = t.v OR abs(s.v - t.v) <= 3"))
def group_agg_distinct(spark, sf_dir):
    return counts.group_aggregations(*sides(spark, sf_dir), [Rule("distinct_count", "o_custkey", "o_custkey", tolerance_abs=3)], "o_orderpriority", "o_orderpriority").select("p", "source", "target", "pass")


@query(f"""WITH {TGT}, s AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, count(*) AS v FROM orders GROUP BY 1), t AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, count(*) AS v FROM tgt GROUP BY 1)
SELECT coalesce(s.p, t.p) AS p, CAST(s.v AS DOUBLE) AS source, CAST(t.v AS DOUBLE) AS target FROM s FULL JOIN t ON s.p = t.p WHERE s.v IS DISTINCT FROM t.v""")
def partitions_month(spark, sf_dir):
    month = "date_format(o_orderdate, 'yyyy-MM')"
    return counts.partitions(*sides(spark, sf_dir), month, month).where("not pass").select("p", "source", "target")


@query(f"""WITH {TGT}, s AS (SELECT o_custkey AS p, count(*) AS v FROM orders GROUP BY 1), t AS (SELECT o_custkey AS p, count(*) AS v FROM tgt GROUP BY 1)
SELECT CAST(coalesce(s.p, t.p) AS BIGINT) AS p, CAST(s.v AS DOUBLE) AS source, CAST(t.v AS DOUBLE) AS target FROM s FULL JOIN t ON s.p = t.p WHERE s.v IS DISTINCT FROM t.v ORDER BY 1 LIMIT 5""")
def group_top_n(spark, sf_dir):
    groups = counts.group_aggregations(*sides(spark, sf_dir), [Rule("count")], "o_custkey", "o_custkey")
    return counts.differing(groups, 5).select("p", "source", "target")


def _hash_sql(algorithm: str, case: str = "upper", null: str = "", price: str = "o_totalprice") -> str:
    fold = {"upper": "upper({})", "lower": "lower({})", "none": "{}"}[case]
    text = [fold.format(f"coalesce(CAST({c} AS VARCHAR), '{null}')") for c in ("o_orderkey", "o_orderpriority", f"CAST({price} AS DECIMAL(38,6))", "o_orderdate")]
    if algorithm == "double_md5":
        return "md5(concat_ws('|', " + ", ".join(f"md5({t})" for t in text) + "))"
    return f"{'md5' if algorithm == 'md5_row' else 'sha256'}(concat_ws('|', {', '.join(text)}))"


def _hashed(df: DataFrame, policy: HashPolicy) -> DataFrame:
    return df.select("o_orderkey", row_hash(df, ["o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"], policy).alias("h"))


def _hash_query(name: str, policy: HashPolicy, price: str = "o_totalprice"):
    def run(spark, sf_dir):
        return _hashed(table(spark, sf_dir, "orders").withColumn("o_totalprice", F.expr(price)), policy)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT o_orderkey, {_hash_sql(policy.algorithm, policy.case, policy.null_token, price)} AS h FROM orders"


_hash_query("hash_double_md5", HashPolicy("double_md5"))
_hash_query("hash_md5_row", HashPolicy("md5_row"))
_hash_query("hash_sha256_row", HashPolicy("sha256_row"))
_hash_query("hash_null_token", HashPolicy("double_md5", null_token="<null>"), "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END")
_hash_query("hash_case_lower", HashPolicy("md5_row", null_token="<NULL>", case="lower"), "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END")
_hash_query("hash_case_none", HashPolicy("md5_row", case="none"))


#: Doubles that no decimal(38,6) holds, beside one that it does.
ODD = "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN {c}1e-8{d} WHEN 1 THEN {c}2e-7{d} WHEN 2 THEN {c}1e40{d} WHEN 3 THEN {c}'NaN'{d} WHEN 4 THEN {c}'Infinity'{d} WHEN 5 THEN {c}'-Infinity'{d} WHEN 6 THEN NULL ELSE {c}1.25{d} END"
ODD = ODD.format(c="CAST(", d=" AS DOUBLE)")
_TEXT_OF_ODD = "CASE WHEN v IS NULL THEN '' WHEN isnan(v) THEN 'NAN' WHEN isinf(v) AND v > 0 THEN 'INFINITY' WHEN isinf(v) THEN '-INFINITY' WHEN CAST(TRY_CAST(v AS DECIMAL(38,6)) AS DOUBLE) = v THEN CAST(CAST(v AS DECIMAL(38,6)) AS VARCHAR) ELSE upper(regexp_replace(regexp_replace(CAST(v AS VARCHAR), 'e([-+])0*', 'e\\1'), '\\+', '')) END"


@query(f"SELECT o_orderkey, md5(concat_ws('|', md5(CAST(o_orderkey AS VARCHAR)), md5({_TEXT_OF_ODD}))) AS h FROM (SELECT o_orderkey, {ODD} AS v FROM orders)")
def hash_odd_doubles(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ODD).alias("v"))
    return df.select("o_orderkey", row_hash(df, ["o_orderkey", "v"]).alias("h"))


@query("""WITH n AS (SELECT count(*) FILTER (WHERE o_orderkey % 8 IN (0, 2, 3, 6)) AS k FROM orders)
SELECT k AS missing_count, k AS extra_count, CASE WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n""")
def hash_diff_odd_doubles(spark, sf_dir):
    """Each of four kinds of rows differs: 1e-8 from 3e-8, 1e40 from 2e40, NaN from NULL, and NULL from NaN."""
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ODD).alias("v"))
    kind = F.col("o_orderkey") % 8
    t = s.withColumn("v", F.when(kind == 0, F.lit(3e-8)).when(kind == 2, F.lit(2e40)).when(kind == 6, F.lit(float("nan"))).when(kind != 3, F.col("v")))
    return rows.hash_diff(s, t, ["o_orderkey", "v"])


def _hash_diff(cols: list[str]) -> str:
    h = "md5(concat_ws('|', " + ", ".join(f"md5(upper(coalesce(CAST({c} AS VARCHAR), '')))" for c in cols) + "))"
    return f"""WITH {TGT}, s AS (SELECT DISTINCT {h} AS h FROM orders), t AS (SELECT DISTINCT {h} AS h FROM tgt),
c AS (SELECT (SELECT count(*) FROM s WHERE h NOT IN (SELECT h FROM t)) AS missing_count, (SELECT count(*) FROM t WHERE h NOT IN (SELECT h FROM s)) AS extra_count)
SELECT *, CASE WHEN missing_count = 0 AND extra_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""


@query(_hash_diff(["o_orderkey", "o_orderstatus", "CAST(o_totalprice AS DECIMAL(38,6))"]))
def hash_diff_counts(spark, sf_dir):
    return rows.hash_diff(*sides(spark, sf_dir), ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(_hash_diff(["o_custkey", "substr(o_orderpriority, 1, 1)"]))
def hash_diff_include_map(spark, sf_dir):
    from .sources.sides import align

    found = align(include_map={"customer": {"source": "o_custkey", "target": "o_custkey"}, "urgency": {"source": "substr(o_orderpriority, 1, 1)", "target": "left(o_orderpriority, 1)"}})
    return rows.hash_diff(*found.apply(*sides(spark, sf_dir)), found.names)


JOINED = f"{TGT}, j AS (SELECT s.o_orderkey AS sk, t.o_orderkey AS tk, s.o_orderstatus AS ss, t.o_orderstatus AS ts, s.o_totalprice AS sp, t.o_totalprice AS tp FROM orders s FULL JOIN tgt t ON s.o_orderkey = t.o_orderkey)"


def _rowdiff(spark, sf_dir, **kw) -> rows.RowDiff:
    return rows.RowDiff(*sides(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"], **kw)


def _summary(price: str) -> str:
    bad = f"(CASE WHEN ss <> ts THEN 1 ELSE 0 END + CASE WHEN {price} THEN 1 ELSE 0 END)"
    return f"""WITH {JOINED}, c AS (SELECT count(*) FILTER (WHERE tk IS NULL) AS missing_count_on_target, count(*) FILTER (WHERE sk IS NULL) AS extra_count_on_target,
  count(*) FILTER (WHERE sk IS NOT NULL AND tk IS NOT NULL AND {bad} > 0) AS mismatch_rows, CAST(coalesce(sum({bad}) FILTER (WHERE sk IS NOT NULL AND tk IS NOT NULL), 0) AS BIGINT) AS mismatch_total FROM j)
SELECT *, CASE WHEN missing_count_on_target + extra_count_on_target + mismatch_total = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""


@query(_summary("sp <> tp"))
def rowdiff_summary(spark, sf_dir):
    return _rowdiff(spark, sf_dir).summary()


@query(_summary("abs(sp - tp) > 0.5"))
def rowdiff_tolerance(spark, sf_dir):
    return _rowdiff(spark, sf_dir, tolerances={"o_totalprice": rows.Tolerance(abs=0.5)}).summary()


@query(f"WITH {JOINED} SELECT sk AS o_orderkey FROM j WHERE tk IS NULL")
def rowdiff_missing(spark, sf_dir):
    return _rowdiff(spark, sf_dir).missing()


@query(f"WITH {JOINED} SELECT tk AS o_orderkey FROM j WHERE sk IS NULL")
def rowdiff_extra(spark, sf_dir):
    return _rowdiff(spark, sf_dir).extra()


@query(f"""WITH {JOINED} SELECT sk AS o_orderkey, 'o_orderstatus' AS "column", ss AS source, ts AS target FROM j WHERE ss <> ts
UNION ALL SELECT sk, 'o_totalprice', CAST(CAST(sp AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(tp AS DECIMAL(18,2)) AS VARCHAR) FROM j WHERE CAST(sp AS DECIMAL(18,2)) <> CAST(tp AS DECIMAL(18,2))""")
def rowdiff_cells(spark, sf_dir):
    s, t = (x.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")) for x in sides(spark, sf_dir))
    return rows.RowDiff(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).cells()


@query(f"""WITH {TGT}, m AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tgt))
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM m ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def rowdiff_preview_ordered(spark, sf_dir):
    """The first rows of a listing, by the dearest price: a preview is a report of so many rows."""
    s, t = sides(spark, sf_dir)
    diff = rows.RowDiff(s, t, ["o_orderkey"], ["o_orderstatus"], order=["o_totalprice desc"])
    shown = [r["o_orderkey"] for r in diff.missing().limit(20).collect()]
    return spark.createDataFrame(list(zip(shown, range(1, len(shown) + 1), strict=True)), "o_orderkey long, place long")


@query(f"""WITH {TGT}, s AS (SELECT nullif(o_orderkey, 5) AS k, o_orderstatus AS v FROM orders), t AS (SELECT nullif(o_orderkey, 5) AS k, o_orderstatus AS v FROM tgt),
j AS (SELECT s.k AS sk, t.k AS tk, s.v AS sv, t.v AS tv, s.v IS NOT NULL AS ins, t.v IS NOT NULL AS int FROM s FULL JOIN t ON s.k IS NOT DISTINCT FROM t.k)
SELECT count(*) FILTER (WHERE NOT int) AS missing_count_on_target, count(*) FILTER (WHERE NOT ins) AS extra_count_on_target, count(*) FILTER (WHERE sv <> tv) AS mismatch_rows FROM j""")
def rowdiff_null_keys(spark, sf_dir):
    s, t = (x.selectExpr("nullif(o_orderkey, 5) AS k", "o_orderstatus AS v") for x in sides(spark, sf_dir))
    return rows.RowDiff(s, t, ["k"], ["v"]).summary().select("missing_count_on_target", "extra_count_on_target", "mismatch_rows")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0),
j AS (SELECT s.l_orderkey AS sk, t.l_orderkey AS tk, s.l_quantity AS sq, t.l_quantity AS tq FROM s FULL JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
SELECT count(*) FILTER (WHERE tk IS NULL) AS missing_count_on_target, count(*) FILTER (WHERE sk IS NULL) AS extra_count_on_target, count(*) FILTER (WHERE sq <> tq) AS mismatch_rows FROM j""")
def rowdiff_dup_keys(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    found = rows.RowDiff(items, items.where("l_orderkey % 10 <> 0"), ["l_orderkey", "l_linenumber"], ["l_quantity"])
    return found.summary().select("missing_count_on_target", "extra_count_on_target", "mismatch_rows")


def _domain(name: str, predicate: str, make: Callable, tolerance: str = "0", column: str = "o_orderstatus", relation: str = "tgt") -> None:
    QUERIES[name] = lambda spark, sf_dir: make(sides(spark, sf_dir)[1])
    ORACLE_SQL[name] = f"""WITH {TGT}, c AS (SELECT count(*) FILTER (WHERE {predicate}) AS invalid_count, greatest(count(*), 1) AS total_count FROM {relation})
SELECT *, invalid_count * 100.0::DOUBLE / total_count AS invalid_pct, CASE WHEN invalid_count <= 0 OR invalid_count * 100.0::DOUBLE / total_count <= {tolerance} THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""


_NULLED = "(SELECT nullif(o_orderstatus, 'P') AS o_orderstatus FROM tgt)"
_domain("domain_allowed", "o_orderstatus NOT IN ('F', 'O', 'P')", lambda t: columns.domain(t, "o_orderstatus", allowed=["F", "O", "P"]))
_domain("domain_excluded", "o_orderstatus IN ('X')", lambda t: columns.domain(t, "o_orderstatus", excluded=["X"]))
_domain("domain_not_null", "o_orderstatus IS NULL", lambda t: columns.domain(t.selectExpr("nullif(o_orderstatus, 'P') AS o_orderstatus"), "o_orderstatus", excluded=[None]), relation=_NULLED)
_domain("domain_null_is_unknown", "o_orderstatus NOT IN ('F', 'O')", lambda t: columns.domain(t.selectExpr("nullif(o_orderstatus, 'P') AS o_orderstatus"), "o_orderstatus", allowed=["F", "O"]), relation=_NULLED)
_domain("domain_regex", "NOT regexp_matches(o_orderpriority, '^[1-3]-')", lambda t: columns.domain(t, "o_orderpriority", regex="^[1-3]-"))
_domain("domain_range", "o_totalprice < 1000 OR o_totalprice > 400000", lambda t: columns.domain(t, "o_totalprice", low=1000, high=400000))
_domain("domain_tolerance", "o_orderstatus NOT IN ('F', 'O', 'P')", lambda t: columns.domain(t, "o_orderstatus", allowed=["F", "O", "P"], tolerance_pct=5), tolerance="5")


@query("SELECT max(ts) AS latest, date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') / 60e6 AS lag_minutes, CASE WHEN date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') / 60e6 <= 4320 THEN 'PASS' ELSE 'FAIL' END AS status FROM events")
def freshness(spark, sf_dir):
    return columns.freshness(table(spark, sf_dir, "events"), "ts", 4320, AS_OF)


@query("""SELECT * FROM (VALUES ('missing_on_target', 'o_custkey', 'bigint', NULL), ('extra_on_target', 'o_comment', NULL, 'string'), ('type', 'o_totalprice', 'double', 'decimal(18,2)'), ('missing_expected', 'o_clerk', NULL, NULL)) v(kind, "column", source_type, target_type)""")
def schema_drift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    target = orders.drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("O_COMMENT", F.lit(None).cast("string")).withColumnRenamed("o_orderkey", "O_OrderKey")
    return columns.schema_drift(orders, target, expected=["O_ORDERKEY", "o_clerk"])


def _verdict(spark: SparkSession, source, target, ok: bool) -> DataFrame:
    return spark.createDataFrame([(source, target, "PASS" if ok else "FAIL")], "source_value long, target_value long, status string")


TARGET_SQL = """SELECT o_orderkey FROM source_file WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey + 1000000 FROM source_file WHERE o_orderkey % 101 = 0"""


def _orders_source(spark: SparkSession, sf_dir: str) -> Source:
    return Source(spark, f"{sf_dir}/orders.parquet", "parquet")


def _value(spark: SparkSession, sf_dir: str, sql: str):
    return _orders_source(spark, sf_dir).sql(sql).first()[0]


@query("SELECT count(*) FILTER (WHERE o_totalprice < 0) AS source_value, CAST(NULL AS BIGINT) AS target_value, CASE WHEN count(*) FILTER (WHERE o_totalprice < 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders")
def custom_sql_single(spark, sf_dir):
    n = _value(spark, sf_dir, "SELECT count(*) FROM source_file WHERE o_totalprice < 0")
    return _verdict(spark, n, None, custom_sql.single(n))


@query(f"WITH {TGT} SELECT (SELECT count(*) FROM orders) AS source_value, (SELECT count(*) FROM tgt) AS target_value, CASE WHEN abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM tgt)) * 100.0 / (SELECT count(*) FROM tgt) <= 1 THEN 'PASS' ELSE 'FAIL' END AS status")
def custom_sql_dual(spark, sf_dir):
    a, b = (_value(spark, sf_dir, q) for q in ("SELECT count(*) FROM source_file", f"SELECT count(*) FROM ({TARGET_SQL})"))
    return _verdict(spark, a, b, custom_sql.dual(a, b, tol_pct=1))


@query(f"WITH {TGT} SELECT (SELECT max(o_orderkey) FROM orders) AS source_value, (SELECT max(o_orderkey) FROM tgt) AS target_value, CASE WHEN (SELECT max(o_orderkey) FROM orders) > (SELECT max(o_orderkey) FROM tgt) THEN 'PASS' ELSE 'FAIL' END AS status")
def custom_sql_greater(spark, sf_dir):
    a, b = (_value(spark, sf_dir, q) for q in ("SELECT max(o_orderkey) FROM source_file", f"SELECT max(o_orderkey) FROM ({TARGET_SQL})"))
    return _verdict(spark, a, b, custom_sql.dual(a, b, mode="greater"))


def _in_window(spark: SparkSession, sf_dir: str, partitions: Partitions) -> DataFrame:
    """Events of a run's window, selected by a query template."""
    at = lambda name: f"CAST(substring('{{{{ partition_{name}_iso }}}}', 1, 19) AS TIMESTAMP_NTZ)"
    text = f"SELECT event_id, ts, user_id FROM source_file WHERE ts >= {at('start')} AND ts < {at('end')}"
    found = loading.rendered(Query(query=text), {}, loading.window(partitions, AS_OF))
    return Source(spark, f"{sf_dir}/events.parquet", "parquet").read(found)


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
def window_filter_range(spark, sf_dir):
    return _in_window(spark, sf_dir, Partitions("range", start="2024-01-10", end="2024-01-12T06:00:00Z"))


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-02-01'")
def window_filter_rolling(spark, sf_dir):
    return _in_window(spark, sf_dir, Partitions("rolling_days", window=7))


def _checked(spark: SparkSession, sf_dir: str) -> results.RunResult:
    """A run of four checks of orders against its perturbed copy."""
    from .plans import checks

    wanted = [("row_count", {}), ("domain", {"column": "o_orderstatus", "allowed_values": ["F", "O", "P"]}), ("freshness", {"column": "o_orderdate", "max_lag_minutes": 1}), ("stats_compare", {})]
    side = _orders_source(spark, sf_dir)
    orders = TableConfig("orders", Query(), Query(query=TARGET_SQL))
    return results.summed([checks.CHECKS[t](checks.Context(spark, orders, CheckConfig(t, o), side, side, variables={"run_timestamp": AS_OF})) for t, o in wanted])


_STATUSES = f"""WITH {TGT}, c AS (
  SELECT 0 AS i, 'row_count' AS check_type, CASE WHEN (SELECT count(*) FROM orders) = (SELECT count(*) FROM tgt) THEN 'PASS' ELSE 'FAIL' END AS status
  UNION ALL SELECT 1, 'domain', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')) = 0 THEN 'PASS' ELSE 'FAIL' END
  UNION ALL SELECT 2, 'freshness', CASE WHEN (SELECT max(o_orderdate) FROM orders) >= TIMESTAMP '2024-01-31 23:59:00' THEN 'PASS' ELSE 'FAIL' END
  UNION ALL SELECT 3, 'stats_compare', 'SKIP')"""


@query(f"""{_STATUSES} SELECT 'run' AS run_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS overall_status, count(*) FILTER (WHERE status = 'PASS') AS pass_count,
  count(*) FILTER (WHERE status = 'FAIL') AS fail_count, count(*) FILTER (WHERE status = 'SKIP') AS skip_count, CAST(1 AS BIGINT) AS table_count FROM c""")
def run_summary(spark, sf_dir):
    row = results.run_row(_checked(spark, sf_dir), run_id="run", env=None, run_label=None, started=AS_OF, finished=AS_OF)
    return results.frame(spark, [row], results.RUNS_SCHEMA).select("run_id", "overall_status", "pass_count", "fail_count", "skip_count", "table_count")


@query(f"{_STATUSES} SELECT 'run' AS run_id, 'orders' AS table_name, check_type, status, check_type AS method, check_type AS metric_name FROM c")
def check_results_rows(spark, sf_dir):
    found = [results.check_row(c, run_id="run", created=AS_OF) for c in _checked(spark, sf_dir).checks]
    return results.frame(spark, found, results.CHECKS_SCHEMA).select("run_id", "table_name", "check_type", "status", "method", "metric_name")


METRICS = [Metric("count", name="rows"), Metric("sum", "CAST(value AS DECIMAL(18,2))", "total"), Metric("distinct_count", "user_id"), Metric("min", "value"), Metric("max", "value")]


def _changed_events(events: DataFrame) -> DataFrame:
    return events.where("event_id % 211 <> 0").withColumn("value", F.when(F.col("event_id") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))


def _event_stats(spark, sf_dir, granularity: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return stats.table_stats({"source": (events, "ts"), "target": (_changed_events(events), "ts")}, granularity, METRICS, table_name="events", run_id="run", env=None, computed_at=AS_OF)


_KEYS = {"day": "%Y-%m-%d", "week": "%G-W%V", "month": "%Y-%m", "year": "%Y"}


def _stats_sql(granularity: str) -> str:
    return f"""e AS (SELECT 'source' AS side, * FROM events UNION ALL SELECT 'target', event_id, ts, user_id, event_type, CASE WHEN event_id % 97 = 0 THEN value + 1 ELSE value END, props FROM events WHERE event_id % 211 <> 0),
g AS (SELECT side, CAST(date_trunc('{granularity}', ts) AS TIMESTAMP) AS period_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, min(value) AS least, max(value) AS most FROM e GROUP BY ALL),
st AS (SELECT side, period_start, CAST(period_start + INTERVAL 1 {granularity.upper()} AS TIMESTAMP) AS period_end, strftime(period_start, '{_KEYS[granularity]}') AS period_key, m.name AS metric_name,
  CASE m.name WHEN 'rows' THEN CAST(n AS DOUBLE) WHEN 'total' THEN total WHEN 'distinct_count:user_id' THEN users WHEN 'min:value' THEN least ELSE most END AS metric_value, n AS row_count
  FROM g, (VALUES ('rows'), ('total'), ('distinct_count:user_id'), ('min:value'), ('max:value')) m(name))"""


def _stats_query(granularity: str) -> None:
    shown = ["side", "period_start", "period_end", "period_key", "metric_name", "metric_value", "row_count"]
    QUERIES[f"table_stats_{granularity}"] = lambda spark, sf_dir: _event_stats(spark, sf_dir, granularity).select(*shown)
    ORACLE_SQL[f"table_stats_{granularity}"] = f"WITH {_stats_sql(granularity)} SELECT {', '.join(shown)} FROM st"


for _g in _KEYS:
    _stats_query(_g)

COMPARED = f"""WITH {_stats_sql("day")}, p AS (SELECT metric_name, period_key, max(period_start) AS period_start, max(metric_value) FILTER (WHERE side = 'source') AS source, max(metric_value) FILTER (WHERE side = 'target') AS target
  FROM st WHERE metric_name IN ('rows', 'total') AND period_start >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY GROUP BY 1, 2),
d AS (SELECT *, source - target AS diff, abs(source - target) * 100.0 / greatest(abs(source), abs(target), 1e-12) AS pct_diff, CAST(date_diff('second', period_start, TIMESTAMP '2024-02-01') // 86400 AS BIGINT) AS age_days FROM p)"""


def _compared(spark, sf_dir, **kw) -> DataFrame:
    spec = StatsCompare("events", ["rows", "total"], [StatsWindow("day", lookback_days=20), StatsWindow("day", lookback_days=5)], **kw)
    return stats.stats_compare(_event_stats(spark, sf_dir, "day"), spec, AS_OF)


@query(f"{COMPARED} SELECT metric_name, period_key, source, target, diff, pct_diff, age_days, coalesce(pct_diff <= 0.5 OR abs(diff) < 1e-12, false) AS pass FROM d")
def stats_compare(spark, sf_dir):
    return _compared(spark, sf_dir, tolerance_pct=0.5).select("metric_name", "period_key", "source", "target", "diff", "pct_diff", "age_days", "pass")


@query(f"{COMPARED} SELECT metric_name, period_key, CASE WHEN age_days >= 10 THEN 0.1 WHEN age_days * 24 <= 96 THEN 2.0 ELSE 0.5 END AS tolerance_pct, coalesce(pct_diff <= CASE WHEN age_days >= 10 THEN 0.1 WHEN age_days * 24 <= 96 THEN 2.0 ELSE 0.5 END OR abs(diff) < 1e-12, false) AS pass FROM d")
def stats_compare_adaptive(spark, sf_dir):
    rules = [AdaptiveRule("older_than_days", days=10, tolerance_pct=0.1), AdaptiveRule("last_hours", hours=96, tolerance_pct=2)]
    return _compared(spark, sf_dir, tolerance_pct=0.5, adaptive=rules).select("metric_name", "period_key", "tolerance_pct", "pass")


@query(f"""{COMPARED} SELECT metric_name, period_key, CASE WHEN source IS NULL THEN 'missing_source' WHEN target IS NULL THEN 'missing_target' ELSE 'difference' END AS reason,
  CASE WHEN age_days >= 15 AND pct_diff >= 0.2 THEN 'CRITICAL' WHEN abs(diff) < 2 THEN 'INFO' ELSE 'WARNING' END AS severity, CASE WHEN age_days >= 180 THEN 'HIGH' WHEN age_days >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity_level
FROM d WHERE NOT coalesce(abs(diff) < 1e-12, false)""")
def stats_severity(spark, sf_dir):
    rules = [SeverityRule("CRITICAL", older_than_days=15, tolerance_pct_exceeded_gte=0.2), SeverityRule("INFO", tolerance_abs_exceeded_lt=2)]
    return _compared(spark, sf_dir, severity=rules).where("not pass").select("metric_name", "period_key", "reason", "severity", "severity_level")


@query(f"{COMPARED} SELECT metric_name, period_key, diff FROM d WHERE NOT coalesce(abs(diff) < 1e-12, false) ORDER BY diff IS NULL DESC, abs(diff) DESC, metric_name, period_key LIMIT 10")
def stats_worst(spark, sf_dir):
    return stats.worst(_compared(spark, sf_dir)).select("metric_name", "period_key", "diff")


@query("SELECT * FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def cdc_latest(spark, sf_dir):
    return latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type = 'error'")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL) AS failed, CASE WHEN count(nullif(o_orderstatus, 'P')) >= count(*) * 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders")
def expect_not_null(spark, sf_dir):
    return expectations.expectation(table(spark, sf_dir, "orders"), "expect_column_values_to_not_be_null", {"column": "nullif(o_orderstatus, 'P')", "mostly": 0.9})


@query("SELECT count(*) AS total, CAST(0 AS BIGINT) AS failed, CASE WHEN count(*) BETWEEN 1 AND 100000000 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders")
def expect_row_count_between(spark, sf_dir):
    return expectations.expectation(table(spark, sf_dir, "orders"), "expect_table_row_count_to_be_between", {"min_value": 1, "max_value": 100000000})


@query("SELECT count(*) AS total, count(*) FILTER (WHERE nullif(c_mktsegment, 'BUILDING') IS NULL) AS failed, CASE WHEN count(*) FILTER (WHERE nullif(c_mktsegment, 'BUILDING') IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM customer")
def soda_missing_count(spark, sf_dir):
    return expectations.check_line(table(spark, sf_dir, "customer").withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')")), "missing_count(segment) = 0")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS failed, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) < 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM customer")
def soda_invalid_count(spark, sf_dir):
    return expectations.check_line(table(spark, sf_dir, "customer"), "invalid_count(c_acctbal) < 100", valid_min=0)


@query("SELECT count(*) AS total, count(*) AS failed, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM customer")
def soda_row_count(spark, sf_dir):
    return expectations.check_line(table(spark, sf_dir, "customer"), "row_count > 0")
