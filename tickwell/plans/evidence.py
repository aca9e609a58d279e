"""Queries over documents: contracts, pointers, lineage, replay. Documents are packed from the conversations, a document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.operators import documents as D
from tickwell.operators import filings as K
from tickwell.operators import intervals as V
from tickwell.operators import lineage as N
from tickwell.operators import replay as P
from tickwell.sources.bars import table
from tickwell.sources.shared import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}

CONVERSATION = {
    "type": "object",
    "additionalProperties": False,
    "required": ["artifact_type", "conv_id", "created_at", "roles", "turns"],
    "properties": {
        "artifact_type": {"const": "conversation"},
        "conv_id": {"type": "integer", "minimum": 3},
        "created_at": {"type": "string", "format": "date-time"},
        "share": {"type": "number", "exclusiveMaximum": 1, "minimum": 0},
        "roles": {"type": "array", "uniqueItems": True},
        "turns": {
            "type": "array",
            "minItems": 3,
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["turn", "text"],
                "properties": {"turn": {"type": "integer", "maximum": 5}, "role": {"enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 120, "pattern": r"[.!?]\z"}},
            },
        },
    },
}


def _turns(spark: SparkSession, d: str, *columns) -> DataFrame:
    """conv_id and ``columns`` of each turn, dealt out by conversation. A turn is few bytes and its nodes are much work, so the number of parts is
    given: one that follows the bytes leaves the work of all documents to a task or two."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return table(spark, d, "conversations").select("conv_id", *columns).repartition(parts, "conv_id")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """(doc, value): each conversation as JSON, with faults that follow from its number."""
    k = F.col("conv_id")
    turn = F.struct("turn", "role", "text")
    per = _turns(spark, d, "turn", "role", "text").groupBy(k).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.to_json(F.struct(
        F.when(k % 29 != 0, "conversation").otherwise("talk").alias("artifact_type"), k, F.concat(F.lit("2024-01-"), F.lpad((1 + k % 33).cast("string"), 2, "0"), F.lit("T08:00:00"), F.when(k % 10 == 0, "").otherwise("+01:00")).alias("created_at"),
        F.when(k % 5 == 0, (k % 4) / 2.0).alias("share"), F.when(k % 13 == 0, k).alias("extra/one"), F.when(k % 6 != 0, F.col("turns.role")).alias("roles"),
        F.when(k % 19 != 0, F.col("turns")).alias("turns"), F.when(k % 19 == 0, "none").alias("turns_"),
    ))
    text = F.when(k % 31 == 0, F.concat(F.lit("["), text)).otherwise(F.replace(text, F.lit("turns_"), F.lit("turns")))
    return per.select(k.alias("doc"), text.alias("value"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    found = D.nodes(conversations(spark, d).withColumn("contract", F.lit("conversation")), keep=("doc", "contract"), most=6)
    return D.validate(found, D.rule_table(spark, {"conversation": CONVERSATION}))


QUERIES["document_validation"] = _validated
SQL["document_validation"] = r"""
WITH g AS (SELECT conv_id AS doc, count(*) AS n, count(DISTINCT role) AS roles, count(role) AS with_role FROM conversations GROUP BY conv_id),
ok AS (SELECT * FROM g WHERE doc % 31 <> 0),
t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, turn, role, text FROM conversations WHERE conv_id % 31 <> 0 AND conv_id % 19 <> 0)
SELECT doc, '' AS path, 'json' AS rule FROM g WHERE doc % 31 = 0
UNION ALL SELECT doc, '/artifact_type', 'const' FROM ok WHERE doc % 29 = 0
UNION ALL SELECT doc, '/conv_id', 'minimum' FROM ok WHERE doc < 3
UNION ALL SELECT doc, '/created_at', 'format' FROM ok WHERE doc % 33 > 30 OR doc % 10 = 0
UNION ALL SELECT doc, '/share', 'exclusiveMaximum' FROM ok WHERE doc % 5 = 0 AND doc % 4 >= 2
UNION ALL SELECT doc, '/extra~1one', 'additional' FROM ok WHERE doc % 13 = 0
UNION ALL SELECT doc, '/roles', 'required' FROM ok WHERE doc % 6 = 0
UNION ALL SELECT doc, '/roles', 'uniqueItems' FROM ok WHERE doc % 6 <> 0 AND roles < with_role
UNION ALL SELECT doc, '/turns', 'type' FROM ok WHERE doc % 19 = 0
UNION ALL SELECT doc, '/turns', 'minItems' FROM ok WHERE doc % 19 <> 0 AND n < 3
UNION ALL SELECT doc, '/turns/' || i || '/turn', 'maximum' FROM t WHERE turn > 5
UNION ALL SELECT doc, '/turns/' || i || '/role', 'enum' FROM t WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT doc, '/turns/' || i || '/text', 'minLength' FROM t WHERE length(text) < 120
UNION ALL SELECT doc, '/turns/' || i || '/text', 'pattern' FROM t WHERE NOT regexp_matches(text, '[.!?]\z')
UNION ALL SELECT doc, '/turns/' || i || '/text', 'required' FROM t WHERE text IS NULL
"""


def _pointers(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.explode(F.expr("""array(
        '/turns/' || turn || '/text', '/turns/' || (turn + 4) || '/role', '/turns/0' || turn, '/turns/-', '/turns/' || turn || '/missing', '/conv_id/' || turn, '/extra~1one', '/extra~2one',
        'turns/' || turn, '', '/turns/' || turn || '/turn')""")).alias("pointer"))
    asked = asked.unionByName(asked.select((-1 - F.col("doc")).alias("doc"), "pointer").where("pointer = ''"))
    out = D.resolve(D.nodes(conversations(spark, d), most=6), asked)
    return out.select("doc", "pointer", "status", "kind", F.when(F.col("kind") == "string", F.col("text")).alias("text"), "number")


QUERIES["json_pointers"] = _pointers
SQL["json_pointers"] = r"""
WITH g AS (SELECT conv_id AS doc, count(*) AS n FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, turn, role, text FROM conversations),
a AS (SELECT DISTINCT conv_id AS doc, turn, unnest(range(11)) AS form FROM conversations),
p AS (SELECT doc, form, CASE form WHEN 1 THEN turn + 4 ELSE turn END AS i, turn,
  CASE form WHEN 0 THEN '/turns/' || turn || '/text' WHEN 1 THEN '/turns/' || (turn + 4) || '/role' WHEN 2 THEN '/turns/0' || turn WHEN 3 THEN '/turns/-' WHEN 4 THEN '/turns/' || turn || '/missing' WHEN 5 THEN '/conv_id/' || turn
    WHEN 6 THEN '/extra~1one' WHEN 7 THEN '/extra~2one' WHEN 8 THEN 'turns/' || turn WHEN 9 THEN '' ELSE '/turns/' || turn || '/turn' END AS pointer FROM a),
s AS (SELECT p.doc, form, pointer, CASE WHEN form = 8 THEN 'malformed' WHEN p.doc % 31 = 0 THEN 'no_document' WHEN form = 9 THEN 'resolved' WHEN form = 5 THEN 'through_scalar' WHEN form = 7 THEN 'invalid_escape'
  WHEN form = 6 THEN CASE WHEN p.doc % 13 = 0 THEN 'resolved' ELSE 'missing_key' END WHEN p.doc % 19 = 0 THEN 'through_scalar' WHEN form IN (2, 3) THEN 'invalid_index'
  WHEN p.i >= n THEN 'out_of_range' WHEN form = 4 THEN 'missing_key' WHEN form = 1 AND role IS NULL THEN 'missing_key' WHEN form = 0 AND text IS NULL THEN 'missing_key' ELSE 'resolved' END AS status, t.turn, t.role, t.text
  FROM p JOIN g USING (doc) LEFT JOIN t ON t.doc = p.doc AND t.i = p.i)
SELECT DISTINCT doc, pointer, status, CASE WHEN status = 'resolved' THEN CASE form WHEN 9 THEN 'object' WHEN 6 THEN 'integer' WHEN 10 THEN 'integer' ELSE 'string' END END AS kind,
  CASE WHEN status = 'resolved' THEN CASE form WHEN 0 THEN text WHEN 1 THEN role END END AS text,
  CASE WHEN status = 'resolved' THEN CASE form WHEN 6 THEN doc::DOUBLE WHEN 10 THEN turn::DOUBLE END END AS number FROM s
UNION ALL SELECT -1 - doc, '', 'no_document', NULL, NULL, NULL FROM g
"""


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """(target, doc, value): for each conversation a valuation over its lengths of texts, its two sources with their snapshots, and a piece
    of research that rests on it. The number of the conversation modulo 23 gives the one fault that is planted."""
    one = F.struct("turn", "role", "fcf")
    per = _turns(spark, d, "turn", "role", F.length("text").cast("double").alias("fcf")).groupBy(F.col("conv_id").alias("k")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    per = per.select("k", F.col("rows.fcf").alias("fcf"), F.transform("rows.role", lambda x: F.coalesce(x, F.lit("none"))).alias("labels"), (F.col("k") % 23).alias("f")).withColumn("n", F.size("fcf"))
    per = per.withColumns({
        "waccs": F.expr("if(f = 14, array(0.1D, 0.11D, 0.12D), array(0.09D, 0.1D, 0.11D))"), "growths": F.expr("array(0.01D, 0.02D, 0.03D)"),
        "pv": F.expr("aggregate(transform(fcf, (x, i) -> x / pow(1.1D, i + 1)), 0D, (a, x) -> a + x)"), "tv": F.expr("fcf[n - 1] * 1.02D / (0.1D - 0.02D) / pow(1.1D, n)"),
    }).withColumns({"ev": F.expr("pv + tv")})
    cite = "named_struct('parameter_pointer', {p}, 'artifact_id', {a}, 'target', 'snapshot', 'json_pointer', {j}, 'reported_value', {v}, 'normalization', named_struct('operation', {o}, 'factor', {x}), 'available_at', {t}, 'availability_ref', {r})"
    none = "cast(null as struct<artifact_id: string, target: string, json_pointer: string>)"
    plain = lambda p, j, v, a="'a' || k": cite.format(p=p, a=a, j=j, v=f"cast({v} as variant)", o="'identity'", x="cast(null as double)", t="cast(null as string)", r=none)
    first = cite.format(
        p="if(f = 1, '/parameters/waccx', '/parameters/wacc')", a="'a' || k", j="if(f = 2, '/nope', '/wacc')", v="cast(if(f = 3, 0.2D, 0.1D) as variant)", o="if(f = 5, 'scale', 'identity')", x="case f when 4 then 1D when 5 then 2D end",
        t="case f when 6 then '2025-01-01T00:00:00Z' when 7 then '2023-12-31T00:00:00Z' when 18 then '2024-01-01T01:00:00+01:00' end", r=f"if(f IN (7, 18), named_struct('artifact_id', 'a' || k, 'target', 'snapshot', 'json_pointer', '/published'), {none})",
    )
    scalars = [plain("'/parameters/terminal_growth'", "'/growth'", "0.02D"), plain("'/parameters/net_debt'", "'/net_debt'", "cast(n as double)", "'s' || k"), plain("'/parameters/non_operating_assets'", "'/assets'", "5D"), plain("'/parameters/diluted_shares'", "'/shares'", "10D")]
    axis = lambda name, of: f"transform({of}, (x, i) -> {plain(f"'/parameters/{name}/' || i", f"'/{of}/' || i", 'x')})"
    flows = [f"transform({of}, (x, i) -> {plain(f"'/parameters/forecasts/' || i || '/{name}'", f"'/{j}/' || i", v)})" for name, of, j, v in (("period", "labels", "labels", "x"), ("unlevered_fcf", "fcf", "fcf", "x"), ("discount_period", "fcf", "years", "i + 1D"))]
    lineage = f"concat(array({', '.join([first, *scalars])}), {axis('wacc_values', 'waccs')}, {axis('terminal_growth_values', 'growths')}, {', '.join(flows)})"
    per = per.withColumn("lineage", F.expr(lineage)).withColumn("lineage", F.expr("case f when 9 then slice(lineage, 1, size(lineage) - 1) when 10 then concat(lineage, slice(lineage, 1, 1)) else lineage end"))
    calculation = """to_json(named_struct('artifact_type', 'calculation', 'calculation_type', if(f = 17, 'other', 'dcf-valuation'), 'entity_id', 'E' || k, 'as_of_cutoff', if(f = 12, '2024-01-04T00:00:00Z', '2024-01-02T00:00:00Z'), 'created_at', '2024-01-03T00:00:00Z',
        'inputs', concat(array(named_struct('artifact_id', 's' || k, 'role', if(f = 0, 'assumption', 'subject')), named_struct('artifact_id', 'a' || k, 'role', 'assumption')), if(f = 8, array(named_struct('artifact_id', 'x' || k, 'role', 'comparison')), array())),
        'parameters', named_struct('forecasts', transform(fcf, (x, i) -> named_struct('period', labels[i], 'unlevered_fcf', x, 'discount_period', i + 1D)), 'wacc', 0.1D, 'terminal_growth', 0.02D, 'net_debt', cast(n as double), 'non_operating_assets', 5D,
            'diluted_shares', 10D, 'wacc_values', waccs, 'terminal_growth_values', growths, 'odd', if(f = 11, 1, null)),
        'lineage', lineage, 'result', named_struct('base', named_struct('pv_forecast_cash_flows', pv, 'pv_terminal_value', tv, 'enterprise_value', if(f = 13, 2 * ev, ev), 'equity_value', ev - n + 5D, 'value_per_share', (ev - n + 5D) / 10D)),
        'reconciliation', named_struct('residual', 0D, 'tolerance', 0.000001D, 'status', 'pass')))"""
    assumed = """to_json(named_struct('fcf', fcf, 'labels', labels, 'years', transform(fcf, (x, i) -> i + 1), 'wacc', 0.1D, 'growth', 0.02D, 'assets', 5, 'shares', 10, 'waccs', waccs, 'growths', growths, 'published', '2024-01-01T00:00:00Z'))"""
    source = "to_json(named_struct('artifact_type', 'source', 'source_kind', 'dataset', 'identifiers', named_struct('entity_id', {e}), 'retrieved_at', '2024-01-02T12:00:00Z', 'as_of_cutoff', {c}))"
    research = """to_json(named_struct('artifact_type', 'research', 'entity_id', 'E' || k, 'as_of_cutoff', '2024-01-05T00:00:00Z', 'created_at', '2024-01-06T00:00:00Z', 'evidence_refs', array(named_struct('artifact_id', 'c' || k))))"""
    kinds = [("artifact", "c", calculation), ("snapshot", "a", assumed), ("snapshot", "s", "to_json(named_struct('net_debt', n))"), ("artifact", "a", source.format(e="'E' || k", c="if(f = 15, '2025-01-01T00:00:00Z', '2024-01-01T00:00:00Z')")),
             ("artifact", "s", source.format(e="if(f = 16, 'F', 'E' || k)", c="'2024-01-01T00:00:00Z'")), ("artifact", "r", research)]
    rows = F.expr(f"array({', '.join(f"named_struct('target', '{t}', 'doc', '{p}' || k, 'value', {v})" for t, p, v in kinds)})")
    return per.select(F.explode(rows).alias("r")).select("r.*")


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    return N.problems(D.nodes(artifacts(spark, d), keep=("target", "doc"), most=6))


QUERIES["lineage_problems"] = _lineage
SQL["lineage_problems"] = """
WITH g AS (SELECT conv_id AS k, conv_id % 23 AS f, count(*) AS n FROM conversations GROUP BY conv_id),
rules(f, prefix, rule, place) AS (VALUES
  (0, 'c', 'no_subject', '/inputs'), (0, 'c', 'role', '/lineage/2'), (1, 'c', 'parameter_unresolved', '/lineage/0'), (1, 'c', 'coverage_missing', '/parameters/wacc'), (1, 'c', 'coverage_unexpected', '/parameters/waccx'),
  (2, 'c', 'source_unresolved', '/lineage/0'), (3, 'c', 'reported_differs', '/lineage/0'), (3, 'c', 'parameter_differs', '/lineage/0'), (4, 'c', 'normalization', '/lineage/0'), (5, 'c', 'parameter_differs', '/lineage/0'),
  (6, 'c', 'available_late', '/lineage/0'), (7, 'c', 'availability_differs', '/lineage/0'), (10, 'c', 'coverage_repeated', '/parameters/wacc'), (11, 'c', 'parameter_unexpected', '/parameters/odd'), (12, 'c', 'created_early', '/created_at'),
  (13, 'c', 'result_differs', '/result/base/enterprise_value'), (13, 'c', 'residual_differs', '/reconciliation/residual'), (13, 'c', 'status_differs', '/reconciliation/status'), (14, 'c', 'axis_center', '/parameters/wacc_values'), (17, 'c', 'kind', '/calculation_type'))
SELECT prefix || k AS doc, rule, place AS "at" FROM g JOIN rules USING (f)
UNION ALL SELECT 'c' || k, 'input_unused', 'x' || k FROM g WHERE f = 8
UNION ALL SELECT 'c' || k, 'coverage_missing', '/parameters/forecasts/' || (n - 1) || '/discount_period' FROM g WHERE f = 9
UNION ALL SELECT 'c' || k, 'upstream_cutoff', 'a' || k FROM g WHERE f = 15
UNION ALL SELECT 'r' || k, 'upstream_cutoff', 'c' || k FROM g WHERE f = 15 
UNION ALL SELECT 'c' || k, 'upstream_entity', 's' || k FROM g WHERE f = 16
"""


def _point_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Studies are orders, whose customer is the driver and whose supplier-like number is the target; flags are returned items, diagnostics are the orders' items."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    day = lambda c: F.unix_date(F.to_date(c))
    k = F.col("o_orderkey")
    ladder = F.element_at(F.array(*map(F.lit, V.LADDER[:4])), (1 + k % 4).cast("int"))
    studies = orders.select(k.alias("study"), (F.col("o_custkey") % 7).alias("driver"), (F.col("o_custkey") % 50).alias("target"), day("o_orderdate").alias("evaluation"), ladder.alias("primary"))
    n = F.col("l_partkey")
    flags = items.where("l_returnflag = 'R'").select((n % 7).alias("driver"), (F.col("l_suppkey") % 50).alias("target"), F.concat(F.lit("code_"), n % 3).alias("code"), day("l_shipdate").alias("effective"), F.when(n % 40 != 0, day("l_shipdate") + n % 5).alias("resolved"))
    told = items.select(F.col("l_orderkey").alias("study"), F.lit("items").alias("family"), F.when(F.col("l_quantity") > 45, "falsifies").otherwise("supports").alias("status"), (day("l_shipdate") - 40).alias("as_of"))
    out = V.point_in_time(studies, flags, told)
    return out.select("study", "statistical", "active", F.concat_ws(",", "codes").alias("codes"), "falsified")


QUERIES["point_in_time"] = _point_in_time
SQL["point_in_time"] = """
WITH s AS (SELECT o_orderkey AS study, o_custkey % 7 AS driver, o_custkey % 50 AS target, CAST(o_orderdate AS DATE) AS evaluation, 1 + o_orderkey % 4 AS place FROM orders),
f AS (SELECT l_partkey % 7 AS driver, l_suppkey % 50 AS target, 'code_' || (l_partkey % 3) AS code, CAST(l_shipdate AS DATE) AS effective,
  CASE WHEN l_partkey % 40 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 5 AS INTEGER) END AS resolved FROM lineitem WHERE l_returnflag = 'R'),
a AS (SELECT study, count(*) AS active, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM s JOIN f USING (driver, target) WHERE effective <= evaluation AND (resolved IS NULL OR evaluation < resolved) GROUP BY study),
g AS (SELECT study, bool_or(l_quantity > 45) AS falsified FROM s JOIN lineitem ON l_orderkey = study WHERE CAST(l_shipdate AS DATE) - 40 <= evaluation GROUP BY study)
SELECT study, CASE WHEN active > 0 THEN 'invalidated' ELSE (['accepted', 'descriptive_only', 'expired', 'quarantined'])[greatest(place, CASE WHEN falsified THEN 2 ELSE 1 END)] END AS statistical,
  coalesce(active, 0) AS active, coalesce(codes, '') AS codes, coalesce(falsified, false) AS falsified
FROM s LEFT JOIN a USING (study) LEFT JOIN g USING (study)
"""


FAMILIES = {"microstructure": "auxiliary", "regime": "auxiliary"}
PARTS = {"method": '{"name":"lead-lag"}', "config": "", "runtime": ""}


def sealed_studies(spark: SparkSession, d: str) -> P.Sealed:
    """A sealed study for each supplier, over the weeks of the orders as sessions. The supplier's number modulo 25 gives the one fault that is planted."""
    k = F.col("study")
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("study"))
    weeks = table(spark, d, "orders").select(F.date_trunc("week", "o_orderdate").alias("t")).distinct().withColumn("i", F.row_number().over(Window.orderBy("t")) - 1)  # a row a week
    weeks = stored(weeks, "weeks")
    ends = weeks.agg(F.count(F.lit(1)).cast("int").alias("n"))
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    grid = base.crossJoin(F.broadcast(weeks)).select("study", "i", day("t").alias("session"), "t")
    hours = lambda h: F.col("t") + F.make_dt_interval(F.lit(0), F.lit(h))
    schedules = grid.select("study", F.lit("source").alias("side"), "session", hours(8).alias("open_at"), hours(20).alias("close_at")).unionByName(grid.select("study", F.lit("target").alias("side"), "session", hours(9).alias("open_at"), hours(15).alias("close_at")))
    before = weeks.select((F.col("i") + 1).alias("i"), day("t").alias("source_session"))
    links = grid.join(F.broadcast(before), "i").select("study", "source_session", F.col("session").alias("target_session")).where((k % 25 != 3) | (F.col("i") != 40))
    named = weeks.crossJoin(ends).agg(*[F.max(F.when(F.col("i") == p, day("t"))).alias(n) for n, p in (("s0", F.lit(0)), ("s1", F.lit(1)), ("last", F.col("n") - 1), ("est", F.col("n") - 11), ("ev2", F.col("n") - 9), ("ev4", F.col("n") - 7), ("x3", F.col("n") - 8), ("x5", F.col("n") - 6), ("b0", F.col("n") - 5))], F.max("n").cast("int").alias("n"))
    late = k % 3 == 0
    studies = base.crossJoin(F.broadcast(named)).withColumns({"f": k % 25, "estimation": F.col("est"), "evaluation": F.when(late, F.col("ev4")).otherwise(F.col("ev2")), "e": F.col("n") - 11})
    contracts = base.select("study", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t or "{}").alias("json")) for p, t in PARTS.items()])).alias("c")).select("study", "c.*")
    contracts = contracts.withColumn("sha256", F.when((k % 25 == 1) & (F.col("part") == "config"), "0").otherwise(F.sha2(F.concat("part", F.lit("\0"), "json").cast("binary"), 256)))
    line = lambda name, kind, timing, first, last, n: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("return_kind"), F.lit(timing).alias("timing_domain"), F.col(first).alias("first"), F.col(last).alias("last"), n.alias("observations"))
    e, n = F.col("e"), F.col("n")
    lineages = studies.select("study", "f", F.explode(F.array(
        line("driver", "source_return", "source_close", "s0", "last", n), line("target_gap", "target_gap", "target_session", "s1", "est", e), line("target_intraday", "target_intraday", "target_session", "s0", "est", e + 1), line("control_1", "control_return", "source_close", "s0", "last", n),
    )).alias("l")).select("study", "f", "l.*")
    name = F.col("name")
    lineages = lineages.select(
        "study", "name", "return_kind", "timing_domain", F.when((F.col("f") == 2) & (name == "driver"), "simple").otherwise("log").alias("return_basis"), F.lit("accepted").alias("status"), "first", "last",
        (F.col("observations") + F.when((F.col("f") == 4) & (name == "control_1"), 1).otherwise(0)).cast("long").alias("observations"),
        F.when((F.col("f") == 5) & (name == "control_1"), "m_driver").when(name == "target_intraday", "m_target_gap").otherwise(F.concat(F.lit("m_"), name)).alias("manifest"), F.concat(F.lit("b_"), name).alias("bars"),
    )
    flags = studies.where("f IN (6, 17)").select("study", F.when(F.col("f") == 6, "Bad Code").otherwise("halt").alias("code"), F.when(F.col("f") == 6, F.col("last")).otherwise(F.col("s1")).alias("effective"), F.lit(None).cast("string").alias("resolved"))
    diagnostics = studies.where("f IN (7, 18)").select("study", F.lit("regime").alias("family"), F.when(F.col("f") == 7, "primary").otherwise("auxiliary").alias("role"), F.when(F.col("f") == 18, "falsifies").otherwise("supports").alias("status"), F.col("s1").alias("as_of"))
    members = spark.createDataFrame([(w, o, h) for w in P.WINDOWS for o in P.OUTCOMES for h in P.HORIZONS], "window int, outcome string, horizon int")
    r = studies.crossJoin(F.broadcast(members)).withColumns({
        "here": (F.col("window") == 63) & (F.col("outcome") == "gap") & (F.col("horizon") == 2),
        "usable": F.expr("window - horizon + 1"), "driver": F.expr("(case outcome when 'gap' then 0.3D when 'intraday' then 0.2D else 0.5D end) * (1 - pow(0.6D, horizon))"), "mse": F.expr("if(outcome = 'total', 2D, 1D)"),
        "falls": F.expr("study % 3 = 0"), "ratio": F.expr("if(outcome = 'total', 1.5D, 1D)"),
    })
    r = r.withColumn("standardized", F.expr("driver / ratio")).withColumn("big", F.expr("abs(standardized) >= 0.1"))
    flagged, falsified = F.col("f") == 17, F.col("f") == 18
    every = F.col("big") & ~F.col("falls")
    primary = F.when(every, "accepted").when(F.col("falls"), "expired").otherwise("descriptive_only")
    reasons = F.array_sort(F.array_compact(F.array(F.lit("current_shock_not_applied"), F.when(~F.col("big"), "standardized_magnitude_below_threshold"), F.when(F.col("falls"), "expired"), F.when(falsified, "auxiliary_falsification"), F.when(flagged, "invalidation_halt"))))
    true = ("sample_size", "bootstrap_interval", "family_wide_fdr", "purged_embargoed_oos", "adjacent_window_drift", "no_detected_structural_break", "preregistered_controls", "global_search_family_registered", "preregistration_bound")
    gates = {g: F.lit(True) for g in true} | {"standardized_magnitude": F.col("big"), "not_expired_at_historical_evaluation": ~F.col("falls"), "no_active_point_in_time_invalidation": ~flagged, "no_auxiliary_falsification": ~falsified}
    fault = lambda f, bad, good: F.when((F.col("f") == f) & F.col("here"), bad).otherwise(good)
    life = F.lit(0.6931471805599453) / -F.log(F.lit(0.6))
    results = r.join(F.broadcast(weeks.select(F.col("i").alias("p"), day("t").alias("base_first"))), F.expr("p = e - window + 1")).join(F.broadcast(weeks.select(F.col("i").alias("p2"), day("t").alias("base_last"))), F.expr("p2 = e - horizon + 1"))
    results = results.where(~((F.col("f") == 13) & F.col("here"))).select(
        "study", "window", "outcome", "horizon", "base_first", "base_last", F.col("usable").cast("long").alias("expected"), fault(8, F.lit(50), F.col("usable")).cast("long").alias("usable"), F.lit(40).cast("long").alias("required"), F.lit(4).cast("long").alias("parameters"),
        fault(14, F.col("driver") + 0.001, F.col("driver")).alias("driver"), F.col("standardized"), (F.col("driver") - 0.01).alias("low"), (F.col("driver") + 0.01).alias("high"), F.expr("(1 + horizon) / 2000D").alias("raw_p"), fault(15, F.lit(0.004), F.lit(0.003)).alias("q_value"),
        F.lit(5).cast("long").alias("adjacent_shift"), (F.col("driver") * 0.5).alias("adjacent"), fault(11, F.lit(False), F.lit(True)).alias("same_direction"), F.lit(1).cast("long").alias("oos_embargo"), fault(9, F.lit(30), F.expr("window - 2 * horizon - 39")).cast("long").alias("oos_n"),
        (F.col("mse") * 0.9).alias("oos_full"), F.col("mse").alias("oos_null"), F.expr("1 - (mse * 0.9D) / mse").alias("oos_gain"), F.lit(True).alias("oos_passed"), F.floor(F.col("usable") / 2).cast("long").alias("break_split"), fault(10, F.lit(0.50001), F.lit(0.5)).alias("break_p"),
        (F.col("driver") * 0.25).alias("break_first"), (F.col("driver") * 0.5).alias("break_second"), F.lit(True).alias("break_passed"), fault(16, F.lit(1.5), life).alias("half_life"), F.col("x5").alias("recalibration"), F.col("x3").alias("half_life_session"), F.col("x5").alias("maximum"),
        fault(19, F.col("x5"), F.col("x3")).alias("expiry"), F.col("falls").alias("expired"), (~F.col("falls")).alias("not_expired"), F.create_map(*[x for g, v in gates.items() for x in (F.lit(g), fault(12, F.lit(False), v) if g == "bootstrap_interval" else v)]).alias("gates"),
        primary.alias("primary_status"), F.when(flagged, "invalidated").when(every & falsified, "descriptive_only").otherwise(primary).alias("statistical_status"), reasons.alias("reasons"),
    )
    got = results.groupBy("study", F.col("statistical_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    counts = base.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in V.LADDER], "status string"))).join(got, ["study", "status"], "left").fillna(0, ["n"])
    counts = counts.withColumn("n", F.when((k % 25 == 20) & (F.col("status") == "quarantined"), 1).otherwise(F.col("n")))
    overall = F.when(F.col("f") == 21, "quarantined").when(flagged, "invalidated").when(late, "expired").when(falsified, "descriptive_only").otherwise("accepted_associations")
    sealed = {"studies": studies.select("study", "estimation", "evaluation", overall.alias("overall")), "contracts": contracts, "lineages": lineages, "schedules": schedules, "links": links, "flags": flags, "diagnostics": diagnostics, "results": results, "counts": counts}
    return P.Sealed(**{name: stored(df, name) for name, df in sealed.items()})


QUERIES["sealed_replay"] = lambda spark, d: P.violations(sealed_studies(spark, d), PARTS, FAMILIES)
SQL["sealed_replay"] = """
WITH s AS (SELECT s_suppkey AS study, s_suppkey % 25 AS f FROM supplier),
weeks AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT date_trunc('week', o_orderdate) AS t FROM orders)),
rules(f, rule, place) AS (VALUES (1, 'L1', 'config'), (2, 'L2', 'driver'), (4, 'L4', 'control_1'), (5, 'L5', 'driver'), (6, 'L6', 'Bad Code'), (7, 'L6', 'regime'), (8, 'L7', '63/gap/2'), (8, 'L9', '63/gap/2'), (9, 'L8', '63/gap/2'), (9, 'L14', '63/2'),
  (10, 'L9', '63/gap/2'), (11, 'L11', '63/gap/2'), (11, 'L12', '63/gap/2'), (12, 'L12', '63/gap/2'), (13, 'L13', '63/gap/2'), (13, 'L14', '63/2'), (14, 'L14', '63/2'), (15, 'L15', '63/gap/2'), (16, 'L16', '63/gap/2'), (19, 'L10', '63/gap/2'), (20, 'L16', 'count/quarantined'), (21, 'L16', 'overall'))
SELECT study, rule, place AS "at" FROM s JOIN rules USING (f)
UNION ALL SELECT study, 'L16', '63/gap/' || h FROM s, range(1, 6) AS t(h) WHERE f = 14 OR (f = 13 AND h <> 2)
UNION ALL SELECT study, 'L3', strftime(t, '%Y-%m-%d') FROM s, weeks WHERE f = 3 AND i = 40
"""


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """Yearly quantities of suppliers as reported facts: documents of facts and of filings, read back by selectors at a cutoff."""
    k, y = F.col("k"), F.col("y")
    year = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("val"))
    accn = F.concat(F.lit("a"), k, F.lit("-"), y)
    fact = F.struct(F.concat(y, F.lit("-01-01")).alias("start"), F.concat(y, F.lit("-12-31")).alias("end"), "val", accn.alias("accn"), y.alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"))
    facts = year.withColumn("f", F.explode(F.when((k + y) % 5 == 2, F.array(fact, fact)).otherwise(F.array(fact)))).groupBy("k").agg(F.sort_array(F.collect_list("f")).alias("f"))
    facts = facts.select(k.cast("string").alias("entity"), F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.col("f").alias("units/1")).alias("units")).alias("Quantity")).alias("us-gaap")).alias("facts"))).alias("value"))
    filed = year.where((k + y) % 5 != 3).groupBy("k").agg(F.sort_array(F.collect_list(F.struct(accn.alias("a"), F.concat(y + 1, F.lit("-02-01T00:00:00Z")).alias("t")))).alias("f"))
    filed = filed.select(k.cast("string").alias("entity"), F.to_json(F.struct(F.struct(F.struct(F.col("f.a").alias("accessionNumber"), F.col("f.t").alias("acceptanceDateTime")).alias("recent")).alias("filings"))).alias("value"))
    unit = F.when((k + y) % 5 == 1, "units/2").otherwise("units/1")
    selectors = year.select(accn.alias("name"), k.cast("string").alias("entity"), F.lit("us-gaap").alias("taxonomy"), F.lit("Quantity").alias("concept"), unit.alias("unit"), accn.alias("accn"), F.lit("10-K").alias("form"), y.alias("fy"), F.lit("FY").alias("fp"), F.concat(y, F.lit("-12-31")).alias("end"), F.concat(y, F.lit("-01-01")).alias("start"), F.when(k % 2 == 0, 0.5).alias("scale"), (k % 3 == 0).alias("negate"))
    out = K.select_facts(K.facts(facts), K.accepted(filed), selectors, "2000-01-01")
    return out.select("name", "status", (F.round("value", 6) + 0.0).alias("value"), "pointer", F.date_format("accepted_at", "yyyy-MM-dd").alias("accepted_at"))


QUERIES["filing_facts"] = _filings
SQL["filing_facts"] = """
WITH t AS (SELECT l_suppkey AS k, year(l_shipdate) AS y, sum(l_quantity) AS val FROM lineitem GROUP BY ALL),
p AS (SELECT *, sum(CASE WHEN (k + y) % 5 = 2 THEN 2 ELSE 1 END) OVER (PARTITION BY k ORDER BY y) - CASE WHEN (k + y) % 5 = 2 THEN 2 ELSE 1 END AS i FROM t)
SELECT name, status, CASE WHEN status = 'ok' THEN round(val * CASE WHEN k % 2 = 0 THEN 0.5 ELSE 1 END * CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END, 6) + 0.0 END AS value, pointer, accepted_at FROM (
  SELECT 'a' || k || '-' || y AS name, k, val, CASE WHEN (k + y) % 5 = 1 THEN 'missing' WHEN (k + y) % 5 = 2 THEN 'ambiguous' WHEN (k + y) % 5 = 3 THEN 'unaccepted' WHEN y >= 1999 THEN 'late' ELSE 'ok' END AS status,
    CASE WHEN (k + y) % 5 <> 1 THEN '/facts/us-gaap/Quantity/units/units~11/' || CAST(i AS BIGINT) END AS pointer, CASE WHEN (k + y) % 5 <> 3 THEN (y + 1) || '-02-01' END AS accepted_at FROM p)
"""
