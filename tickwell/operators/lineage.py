"""Lineage of calculations: each parameter cited once, each citation true, nothing known too late, results recomputed.

All tables come from one node table (see ``documents.nodes``) with the columns target (artifact or snapshot) and doc (the
artifact's id). Rules are joins; a broken rule is a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwell.operators import documents as D
from tickwell.operators.research import dcf
from tickwell.sources.shared import checkpoints, stored

#: By kind of calculation, the fields that an object below /parameters has, all of which are cited. ~i: every
#: place of a list; ~k: any name. A third value gives the state of the object's field ``included`` for which the field is there.
_PERIOD_FIELDS = ("period_end", "accession", "form", "fy", "fp")
_STATEMENT_FIELDS = (
    "period_end", "currency", "unit", "period_basis", "revenue", "cost_of_revenue", "operating_expenses", "operating_income", "net_income", "cash_from_operations",
    "capital_expenditure", "total_assets", "total_liabilities", "total_equity", "cash", "debt",
)
FIELDS: dict[str, dict[str, Sequence[str | tuple[str, str]]]] = {
    "sec-companyfacts-normalization": {
        "/parameters": ("scale", "currency", "unit", "period_basis"),
        "/parameters/periods/~i": _PERIOD_FIELDS,
        "/parameters/periods/~i/fields/~k": ("~k",),
    },
    "financial_statement_analysis": {"/parameters": ("reconciliation_tolerance",), "/parameters/dataset/~i": _STATEMENT_FIELDS},
    "dcf-valuation": {
        "/parameters": ("wacc", "terminal_growth", "net_debt", "non_operating_assets", "diluted_shares"),
        "/parameters/wacc_values": ("~i",), "/parameters/terminal_growth_values": ("~i",),
        "/parameters/forecasts/~i": ("period", "unlevered_fcf", "discount_period"),
    },
    "comps-valuation": {
        "/parameters": ("subject_metric", "basis", "diluted_shares", "net_debt", "non_operating_assets", "statistic", "explicit_multiple"),
        "/parameters/peers/~i": ("name", "included", ("numerator", "true"), ("denominator", "true"), ("exclusion_reason", "false")),
    },
}
#: The lists and objects below /parameters that are not cited themselves, by kind.
CONTAINERS = {
    "sec-companyfacts-normalization": {"/parameters": ("periods",), "/parameters/periods/~i": ("fields",)},
    "financial_statement_analysis": {"/parameters": ("dataset",)},
    "dcf-valuation": {"/parameters": ("forecasts", "wacc_values", "terminal_growth_values")},
    "comps-valuation": {"/parameters": ("peers",)},
}
#: Fixed values: (kind, pattern of the parameter's pointer, role that its source must have among the inputs); the first that fits counts.
ROLES = (
    ("sec-companyfacts-normalization", "", "assumption"),
    ("financial_statement_analysis", "^/parameters/dataset/", "subject"), ("financial_statement_analysis", "", "assumption"),
    ("dcf-valuation", "^/parameters/net_debt$", "subject"), ("dcf-valuation", "", "assumption"),
    ("comps-valuation", "^/parameters/peers/", "comparison"), ("comps-valuation", "^/parameters/(subject_metric|diluted_shares|net_debt|non_operating_assets)$", "subject"), ("comps-valuation", "", "assumption"),
)
#: Fixed value: numbers of two documents are equal within this.
NEAR = 1e-12

_c = F.col


def members(found: DataFrame, shape: str, fields: Mapping[str, str], keys: Sequence[str] = ("target", "doc")) -> DataFrame:
    """(keys, at, fields): a row for each node of ``shape``, with nodes below it as columns; a name that ends in # is the number, in ? the kind, else the text.

    The columns come from the node's own value, so nothing is shuffled; a document that is there twice has its rows twice.
    """
    what = lambda name: "number" if name.endswith("#") else "kind" if name.endswith("?") else "text"
    rows = found.where(_c("shape") == shape).withColumn("at", _c("path"))
    return D.members(rows, {n.rstrip("#?"): (s, what(n)) for n, s in fields.items()}, [*keys, "at"])


def records(found: DataFrame, shape: str, fields: Mapping[str, str], keys: Sequence[str] = ("target", "doc")) -> DataFrame:
    """``members`` with one row for each (keys, at)."""
    rows = members(found, shape, fields, keys)
    return rows.groupBy(*keys, "at").agg(*[F.max(n).alias(n) for n in (n.rstrip("#?") for n in fields)])


def _instant(text: Column) -> Column:
    return F.when(text.rlike(D.RFC3339), F.try_to_timestamp(text))


def heads(found: DataFrame) -> DataFrame:
    """(doc, type, kind, entity, cutoff, created, source_kind) of each artifact."""
    rows = records(found.where("target = 'artifact'"), "", {
        "type": "artifact_type", "kind": "calculation_type", "entity_id": "entity_id", "identifier": "identifiers/entity_id", "as_of": "as_of_cutoff",
        "created_at": "created_at", "retrieved_at": "retrieved_at", "source_kind": "source_kind",
    })
    entity = F.when(_c("type") == "source", _c("identifier")).otherwise(_c("entity_id"))
    return rows.select("doc", "type", "kind", entity.alias("entity"), _instant(_c("as_of")).alias("cutoff"), _instant(F.coalesce("created_at", "retrieved_at")).alias("created"), "source_kind")


def inputs(found: DataFrame) -> DataFrame:
    """(doc, at, source, role) of the declared inputs of calculations and the evidence of research."""
    own = found.where("target = 'artifact'")
    used = records(own, "/inputs/~i", {"source": "artifact_id", "role": "role"})
    return used.unionByName(records(own, "/evidence_refs/~i", {"source": "artifact_id", "role": "role"})).drop("target")


def citations(found: DataFrame) -> DataFrame:
    """A row for each lineage record (``members``)."""
    return members(found.where("target = 'artifact'"), "/lineage/~i", {
        "parameter_pointer": "parameter_pointer", "source": "artifact_id", "of": "target", "json_pointer": "json_pointer", "reported": "reported_value", "reported_kind?": "reported_value", "reported_number#": "reported_value",
        "operation": "normalization/operation", "factor": "normalization/factor", "factor_number#": "normalization/factor", "available_at": "available_at",
        "available_source": "availability_ref/artifact_id", "available_of": "availability_ref/target", "available_pointer": "availability_ref/json_pointer",
    }).drop("target")


class Evidence(NamedTuple):
    """A node table without texts, which are told from values where they are asked for, and what is read from it; ``evidence`` writes each to the shared folder once."""

    found: DataFrame
    heads: DataFrame
    inputs: DataFrame
    citations: DataFrame


def evidence(found: DataFrame) -> Evidence:
    found = stored(found.select("target", "doc", "path", "shape", "place", "value", "kind", "size", "keys", "number"), "nodes")
    return Evidence(found, *(stored(f(found), f.__name__) for f in (heads, inputs, citations)))


def required(found: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers that each calculation must cite, (doc, pointer), and its parameters that are missing or not of its kind, (doc, rule, at).

    ``kinds``: (doc, kind_of). The rule tables hold a row for each fixed field and are broadcast: they have a few keys, which all documents share.
    """
    spark = found.sparkSession
    cited = [(k, p, f if isinstance(f, str) else f[0], None if isinstance(f, str) else f[1]) for k, s in FIELDS.items() for p, fs in s.items() for f in fs]
    known = cited + [(k, p, f, None) for k, s in CONTAINERS.items() for p, fs in s.items() for f in fs]
    below = found.where("target = 'artifact' AND kind IN ('object', 'array') AND (path = '/parameters' OR path LIKE '/parameters/%')").join(kinds, "doc")
    generic = F.regexp_replace("shape", "^(/parameters/periods/~i/fields)/[^/]+", r"$1/~k")
    below = below.select("doc", "kind_of", "path", "keys", "size", generic.alias("shape"), _c("kind").alias("node"), F.expr("try_variant_get(value, '$.included', 'string')").alias("included"))
    rule = lambda r: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("kind_of", "shape", "field", "included_is"), r, strict=True)])
    table = lambda rows: F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.array(*map(rule, rows)))))
    fits = _c("included_is").isNull() | (_c("included_is") == _c("included"))
    hit = below.join(table(cited), ["kind_of", "shape"]).where(fits)
    names = F.when(_c("field") == "~i", F.expr("if(node = 'array' and size > 0, transform(sequence(0, size - 1), i -> cast(i as string)), array())"))
    names = names.when(_c("field") == "~k", F.coalesce("keys", F.array().cast("array<string>"))).when(_c("node") == "object", F.array("field")).otherwise(F.array().cast("array<string>"))
    pointers = hit.select("doc", "path", F.explode(names).alias("name")).select("doc", D.pointer_of([_c("name")]).alias("step"), "path").select("doc", F.concat("path", "step").alias("pointer")).distinct()
    fields = below.where("node = 'object'").join(table([r for r in known if r[2] != "~k"]), ["kind_of", "shape"])
    per = fields.groupBy("doc", "path").agg(F.first("keys").alias("keys"), F.collect_set(F.when(fits, _c("field"))).alias("expected"))
    wrong = F.concat(
        F.transform(F.array_except("expected", "keys"), lambda k: F.struct(F.lit("parameter_missing").alias("rule"), k.alias("name"))),
        F.transform(F.array_except("keys", "expected"), lambda k: F.struct(F.lit("parameter_unexpected").alias("rule"), k.alias("name"))),
    )
    odd = per.select("doc", "path", F.explode(wrong).alias("w")).select("doc", _c("w.rule").alias("rule"), F.concat("path", D.pointer_of([_c("w.name")])).alias("at"))
    return pointers, odd


def carried(own: DataFrame, edges: DataFrame, most: int = 64, values: Sequence[str] = ("value",)) -> DataFrame:
    """(node, values): for each of ``values`` the greatest among a node's own and those of everything it rests on over ``edges`` (src rests on dst).

    ``own``: (node, values). A round joins only what has changed in the one before, and the last changes nothing, so cycles end too;
    a chain that is longer than ``most`` raises.
    """
    checkpoints(own.sparkSession)
    state = own.select("node", *values).checkpoint()
    changed = state
    for _ in range(most):
        told = edges.join(changed.withColumnRenamed("node", "dst"), "dst").groupBy(_c("src").alias("node")).agg(*[F.max(v).alias(f"news_{v}") for v in values])
        grown = F.lit(False)
        for v in values:
            grown = grown | F.coalesce((_c(f"news_{v}") > _c(v)) | (_c(v).isNull() & _c(f"news_{v}").isNotNull()), F.lit(False))
        both = state.join(told, "node", "left").select("node", *[F.greatest(v, f"news_{v}").alias(v) for v in values], grown.alias("new")).checkpoint()
        changed, state = both.where("new").select("node", *values), both.select("node", *values)
        if changed.isEmpty():
            return state
    raise ValueError(f"a chain is longer than {most} edges")


def _equal(kind_a: Column, text_a: Column, number_a: Column, kind_b: Column, text_b: Column, number_b: Column) -> Column:
    """Numbers within ``NEAR``, all else by kind and text."""
    both = number_a.isNotNull() & number_b.isNotNull()
    return F.when(both, F.abs(number_a - number_b) <= NEAR).otherwise((kind_a == kind_b) & text_a.eqNullSafe(text_b))


def citation_problems(e: Evidence) -> DataFrame:
    """(doc, rule, at): citations that do not hold.

    parameter_unresolved, source_unresolved; reported_differs (from the cited value); normalization (an operation misused);
    parameter_differs (from the normalised value); available_late; availability_unread; availability_differs; role (the source is no input of
    the role that the parameter needs). A citation that does not resolve breaks nothing else about values. A pointer resolves where a node has it as
    its path, so all pointers of a citation meet the node table in one join, and those that are null meet nothing.
    """
    of, head, used = e.citations, e.heads, e.inputs
    null = F.lit(None).cast("string")
    ask = lambda name, target, doc, pointer, own: F.struct(F.lit(name).alias("name"), target.alias("target"), doc.alias("source"), pointer.alias("path"), own.alias("own"))
    own = F.struct(*[k for k in of.columns if k not in ("doc", "at")])
    none = F.when(F.lit(False), own)
    asks = F.array(
        ask("given", F.lit("artifact"), _c("doc"), _c("parameter_pointer"), own), ask("cited", _c("of"), _c("source"), _c("json_pointer"), none),
        ask("instant", _c("available_of"), _c("available_source"), _c("available_pointer"), none),
    )
    asked = of.select("doc", "at", F.inline(asks)).where("name = 'given' OR (target IS NOT NULL AND source IS NOT NULL AND path IS NOT NULL)")
    held = e.found.where("value IS NOT NULL").select("target", _c("doc").alias("source"), "path", "value")
    status = F.when(_c("path").isNull(), null).when(_c("value").isNull(), "unresolved").otherwise("resolved").alias("status")
    read = asked.join(held, ["target", "source", "path"], "left").withColumn("status", status)
    read = D.members(read, {k: ("", k) for k in ("kind", "text", "number")}, ["doc", "at", "name", "own", "status"])
    read = read.select("doc", "at", "name", "own", F.struct("status", "kind", "text", "number").alias("read"))
    read = read.join(head.select("doc", _c("kind").alias("kind_of"), "cutoff"), "doc")
    names = ("given", "cited", "instant")
    rows = read.groupBy("doc", "at", "kind_of", "cutoff").agg(F.max("own").alias("own"), *[F.max(F.when(_c("name") == n, _c("read"))).alias(n) for n in names])
    rows = rows.select("doc", "at", "kind_of", "cutoff", "own.*", *[_c(f"{n}.{k}").alias(f"{n}_{k}") for n in names for k in ("status", "kind", "text", "number")])
    roles = used.groupBy("doc", "source").agg(F.collect_set("role").alias("roles"))
    rows = rows.join(roles, ["doc", "source"], "left")
    need = null
    for kind, pattern, role in reversed(ROLES):
        need = F.when((_c("kind_of") == kind) & _c("parameter_pointer").rlike(pattern), role).otherwise(need)
    good = (_c("given_status") == "resolved") & (_c("cited_status") == "resolved")
    plain, number = _c("operation") == "identity", _c("reported_number").isNotNull()
    usable = F.coalesce((plain & _c("factor").isNull()) | ((_c("operation") == "negate") & _c("factor").isNull() & number) | ((_c("operation") == "scale") & _c("factor_number").isNotNull() & number), F.lit(False))
    scaled = F.when(plain, _c("reported_number")).when(_c("operation") == "negate", -_c("reported_number")).otherwise(_c("reported_number") * _c("factor_number"))
    same_cited = _equal(_c("cited_kind"), _c("cited_text"), _c("cited_number"), _c("reported_kind"), _c("reported"), _c("reported_number"))
    same_parameter = _equal(_c("given_kind"), _c("given_text"), _c("given_number"), _c("reported_kind"), _c("reported"), scaled)
    available, instant = _instant(_c("available_at")), _instant(F.when(_c("instant_kind") == "string", _c("instant_text")))
    told_when = _c("available_pointer").isNotNull() & _c("available_at").isNotNull()
    rules = {
        "parameter_unresolved": _c("given_status") != "resolved",
        "source_unresolved": (_c("given_status") == "resolved") & (_c("cited_status") != "resolved"),
        "reported_differs": good & ~same_cited,
        "normalization": good & ~usable,
        "parameter_differs": good & usable & ~same_parameter,
        "available_late": good & (available > _c("cutoff")),
        "availability_unread": good & told_when & instant.isNull(),
        "availability_differs": good & told_when & (instant != available),
        "role": good & need.isNotNull() & ~F.coalesce(F.array_contains("roles", need), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(rule)) for rule, b in rules.items()]))
    return rows.select("doc", F.explode(broken).alias("rule"), "at")


def inventory_problems(e: Evidence) -> DataFrame:
    """(doc, rule, at): what calculations declare against what they use.

    no_subject; input_unused and input_undeclared (sources of inputs and of citations, a full join; a normalization of filings is held to its
    inputs of the role assumption); coverage_missing, coverage_unexpected, coverage_repeated (pointers of parameters that must be and are
    cited); parameter_missing and parameter_unexpected; kind (no rules for this kind of calculation).
    """
    head = e.heads.where("type = 'calculation'").select("doc", _c("kind").alias("kind_of"))
    used, of = e.inputs.join(head, "doc"), e.citations.join(head, "doc")
    told = lambda df, rule, at: df.select("doc", F.lit(rule).alias("rule"), at.alias("at"))
    subject = used.where("role = 'subject'").select("doc").distinct()
    declared = used.where("kind_of <> 'sec-companyfacts-normalization' OR role = 'assumption'").select("doc", "source").distinct()
    cited = of.select("doc", F.explode(F.array_compact(F.array("source", "available_source"))).alias("source")).distinct()
    need, odd = required(e.found, head.where(_c("kind_of").isin(*FIELDS)))
    both = lambda a, b, keys: a.withColumn("left", F.lit(True)).join(b.withColumn("right", F.lit(True)), keys, "full")
    rule = lambda broken, name: F.when(F.coalesce(broken, F.lit(False)), name)
    per = of.where("parameter_pointer IS NOT NULL").groupBy("doc", _c("parameter_pointer").alias("pointer")).agg((F.min("at") != F.max("at")).alias("again"), F.first("kind_of").alias("kind_of"))
    covered = both(need, per, ["doc", "pointer"]).select("doc", "pointer", F.explode(F.array_compact(F.array(
        rule(_c("right").isNull(), "coverage_missing"), rule(_c("left").isNull() & _c("kind_of").isin(*FIELDS), "coverage_unexpected"), rule(_c("again"), "coverage_repeated"),
    ))).alias("rule"))
    sources = both(declared, cited, ["doc", "source"]).where("left IS NULL OR right IS NULL")
    parts = [
        told(head.join(subject, "doc", "left_anti"), "no_subject", F.lit("/inputs")),
        sources.select("doc", F.when(_c("left").isNull(), "input_undeclared").otherwise("input_unused").alias("rule"), _c("source").alias("at")),
        covered.select("doc", "rule", _c("pointer").alias("at")),
        told(head.where(~F.coalesce(_c("kind_of").isin(*FIELDS), F.lit(False))), "kind", F.lit("/calculation_type")),
        odd,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_problems(e: Evidence) -> DataFrame:
    """(doc, rule, at): what is known too late or of another entity.

    created_early (before the cutoff); upstream_cutoff and upstream_created (of an input or a piece of evidence, or of anything that it rests on,
    carried along the edges); upstream_entity (of a subject or a piece of evidence). ``at`` is the input's artifact.
    """
    head, used = e.heads, e.inputs
    edges = used.select(_c("doc").alias("src"), _c("source").alias("dst")).distinct()
    mine = head.where("type <> 'source'").select("doc", "entity", "cutoff", "created", "type")
    rows = used.join(mine, "doc")
    up = head.select(_c("doc").alias("source"), _c("entity").alias("other"))
    times = ("cutoff", "created")
    got = carried(head.select(_c("doc").alias("node"), *times), edges, values=times)
    up = up.join(got.select(_c("node").alias("source"), *[_c(n).alias(f"upstream_{n}") for n in times]), "source", "left")
    rows = rows.join(up, "source")
    rules = {
        "upstream_cutoff": _c("upstream_cutoff") > _c("cutoff"),
        "upstream_created": _c("upstream_created") > _c("created"),
        "upstream_entity": ((_c("type") == "research") | (_c("role") == "subject")) & ~_c("entity").eqNullSafe(_c("other")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(rule)) for rule, b in rules.items()]))
    late = rows.select("doc", F.explode(broken).alias("rule"), _c("source").alias("at"))
    early = head.where("type <> 'source' AND created < cutoff").select("doc", F.lit("created_early").alias("rule"), F.lit("/created_at").alias("at"))
    return late.unionByName(early)


def reconciliation_problems(e: Evidence) -> DataFrame:
    """(doc, rule, at) of valuations by discounted cash flow: result_differs for each value of /result/base that the parameters do not give
    (relative 1e-9), residual_differs and status_differs of /reconciliation against what the result gives, axis_center where a base rate is not the middle of its axis."""
    own = e.found.where("target = 'artifact'")
    head = e.heads.where("kind = 'dcf-valuation'").select("doc")
    p = records(own, "/parameters", {n + "#": n for n in ("wacc", "terminal_growth", "net_debt", "non_operating_assets", "diluted_shares")}).join(head, "doc").drop("target", "at")
    flows = records(own, "/parameters/forecasts/~i", {"fcf#": "unlevered_fcf", "t#": "discount_period", "period": "period"}).select("doc", "period", "fcf", "t").join(p.select("doc", "wacc", "terminal_growth"), "doc")
    valued = dcf(flows, _c("wacc"), _c("terminal_growth"), by=("doc",)).select("doc", "pv_forecast", "pv_terminal", "enterprise_value").join(p, "doc")
    equity = _c("enterprise_value") - _c("net_debt") + _c("non_operating_assets")
    valued = valued.withColumn("equity", equity).withColumn("share", F.try_divide("equity", "diluted_shares"))
    names = {"pv_forecast_cash_flows": "pv_forecast", "pv_terminal_value": "pv_terminal", "enterprise_value": "enterprise_value", "equity_value": "equity", "value_per_share": "share"}
    base = records(own, "/result/base", {f"told_{n}#": n for n in names}).drop("target", "at")
    rec = records(own, "/reconciliation", {"residual#": "residual", "tolerance#": "tolerance", "status": "status"}).drop("target", "at")
    rows = valued.join(base, "doc", "left").join(rec, "doc", "left")
    off = lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    t = lambda n: _c(f"told_{n}")
    residual = F.greatest(
        off(t("enterprise_value"), t("pv_forecast_cash_flows") + t("pv_terminal_value")), off(t("equity_value"), t("enterprise_value") - _c("net_debt") + _c("non_operating_assets")), off(t("value_per_share"), F.try_divide(t("equity_value"), _c("diluted_shares")))
    )
    wrong = [F.when(~F.coalesce(off(t(n), _c(v)) <= 1e-9, F.lit(False)), F.struct(F.lit("result_differs").alias("rule"), F.lit(f"/result/base/{n}").alias("at"))) for n, v in names.items()]
    wrong.append(F.when(~F.coalesce(F.abs(_c("residual") - residual) <= 1e-15, F.lit(False)), F.struct(F.lit("residual_differs").alias("rule"), F.lit("/reconciliation/residual").alias("at"))))
    wrong.append(F.when(~F.coalesce(_c("status") == F.when(residual <= _c("tolerance"), "pass").otherwise("fail"), F.lit(False)), F.struct(F.lit("status_differs").alias("rule"), F.lit("/reconciliation/status").alias("at"))))
    out = rows.select("doc", F.explode(F.array_compact(F.array(*wrong))).alias("w")).select("doc", "w.*")
    for axis, name in (("wacc_values", "wacc"), ("terminal_growth_values", "terminal_growth")):
        steps = own.where(_c("shape") == f"/parameters/{axis}/~i").select("doc", "place", "number")
        middle = own.where(_c("path") == f"/parameters/{axis}").select("doc", F.floor(_c("size") / 2).cast("int").alias("place")).join(steps, ["doc", "place"], "left")
        off_axis = p.join(middle, "doc", "left").where(~F.coalesce(_c("number") == _c(name), F.lit(False)))
        out = out.unionByName(off_axis.select("doc", F.lit("axis_center").alias("rule"), F.lit(f"/parameters/{axis}").alias("at")))
    return out


def problems(found: DataFrame) -> DataFrame:
    """(doc, rule, at) of all rules above, for a node table with the columns target and doc. Each set of rules is a query of its own, whose rows are written."""
    e = evidence(found)
    parts = [stored(rules(e), rules.__name__) for rules in (citation_problems, inventory_problems, time_problems, reconciliation_problems)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
