"""Replay of sealed lead-lag studies: everything that follows from other sealed values is computed anew, and a difference is a row.

Tables hold many studies at once, keyed by ``study``. Windows run over one study's sessions or members, so a group is a study.

* ``studies``: study, estimation, evaluation (sessions), overall (status)
* ``contracts``: study, part (method, config or runtime), json (canonical text), sha256
* ``lineages``: study, name (driver, target_gap, target_intraday, or a control's series), return_kind, timing_domain, return_basis, status, first,
  last (sessions), observations, manifest, bars (digests)
* ``schedules``: study, side (source or target), session, open_at, close_at; ``links``: study, source_session, target_session
* ``flags`` and ``diagnostics`` as in ``intervals.point_in_time``, by study: (study, code, effective, resolved), (study, family, role, status, as_of)
* ``results``: study, window, outcome, horizon and the columns of ``RESULT``; ``counts``: study, status, n
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwell.operators import asof
from tickwell.operators.intervals import LADDER
from tickwell.operators.leadlag import HORIZONS, OUTCOMES, WINDOWS, half_life
from tickwell.sources.shared import stored

#: Columns of sealed results besides their key.
RESULT = (
    "base_first string, base_last string, expected long, usable long, required long, parameters long, driver double, standardized double, low double, high double, raw_p double, q_value double, "
    "adjacent_shift long, adjacent double, same_direction boolean, oos_embargo long, oos_n long, oos_full double, oos_null double, oos_gain double, oos_passed boolean, "
    "break_split long, break_p double, break_first double, break_second double, break_passed boolean, half_life double, recalibration string, half_life_session string, maximum string, expiry string, "
    "expired boolean, not_expired boolean, gates map<string,boolean>, primary_status string, statistical_status string, reasons array<string>"
)
#: Kind and timing of the primary inputs; families of diagnostics with their roles; states of diagnostics.
PRIMARY = {"driver": ("source_return", "source_close"), "target_gap": ("target_gap", "target_session"), "target_intraday": ("target_intraday", "target_session")}
CODE = r"^[a-z][a-z0-9_]*\z"
#: Gate and the reason that its failure gives to an identified member.
REASONS = {
    "bootstrap_interval": "bootstrap_interval_includes_zero", "family_wide_fdr": "family_wide_fdr_not_passed", "standardized_magnitude": "standardized_magnitude_below_threshold",
    "purged_embargoed_oos": "oos_null_not_beaten", "adjacent_window_drift": "adjacent_window_drift_not_confirmed", "no_detected_structural_break": "structural_break_detected",
    "preregistered_controls": "required_control_contract_empty", "global_search_family_registered": "global_search_family_unregistered", "preregistration_bound": "preregistration_unbound",
}

_c = F.col
_KEY = ["study", "window", "outcome", "horizon"]


@dataclass(frozen=True)
class Policy:
    """Fixed values of the acceptance policy."""

    min_observations: int = 40
    per_parameter: int = 10
    repetitions: int = 1999
    fdr_alpha: float = 0.05
    min_standardized: float = 0.10
    oos_train: int = 40
    oos_predictions: int = 10
    oos_gain: float = 0.01
    embargo: int = 1
    shift: int = 5
    break_alpha: float = 0.05
    recalibration: int = 5
    validity: int = 5
    registered: bool = True  # a digest of the search family and of the preregistration is part of the config


@dataclass(frozen=True)
class Sealed:
    studies: DataFrame
    contracts: DataFrame
    lineages: DataFrame
    schedules: DataFrame
    links: DataFrame
    flags: DataFrame
    diagnostics: DataFrame
    results: DataFrame
    counts: DataFrame


def _told(df: DataFrame, rules: Mapping[str, Column], at: Column) -> DataFrame:
    """(study, rule, at) of each rule that does not hold; a rule that is null does not hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]))
    return df.select("study", F.explode(broken).alias("rule"), at.alias("at"))


def _member() -> Column:
    return F.concat_ws("/", "window", "outcome", "horizon")


def _close(a: Column, b: Column, near: float = 1e-9) -> Column:
    """Both null, or equal within a relative distance."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= near * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(False))


def contract_problems(s: Sealed, parts: Mapping[str, str], domain: str = "") -> DataFrame:
    """L1: each of ``parts`` (name, canonical text that is fixed, or empty for any) is there, as fixed, with the digest of its own text."""
    spark = s.studies.sparkSession
    need = s.studies.select("study").crossJoin(F.broadcast(spark.createDataFrame(list(parts.items()), "part string, fixed string")))
    rows = need.join(s.contracts, ["study", "part"], "left")
    text = F.concat(F.lit(domain), _c("part"), F.lit("\0"), _c("json"))
    ok = ((_c("fixed") == "") | (_c("fixed") == _c("json"))) & (F.sha2(text.cast("binary"), 256) == _c("sha256"))
    return _told(rows, {"L1": ok}, _c("part"))


def lineage_problems(s: Sealed) -> DataFrame:
    """L2 (exact kinds, log returns, accepted, first <= last), L4 (observations are one stretch of the venue's schedule), L5 (manifests are distinct,
    controls do not clone the bars of driver or target)."""
    primary = F.create_map(*[x for k, (kind, timing) in PRIMARY.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(timing).alias("timing")))])
    rows = s.lineages.withColumn("p", F.try_element_at(primary, _c("name")))
    kind = F.when(_c("p").isNull(), (_c("return_kind") == "control_return") & _c("timing_domain").isin("source_close", "target_previous_close")).otherwise((_c("return_kind") == _c("p.kind")) & (_c("timing_domain") == _c("p.timing")))
    out = _told(rows, {"L2": kind & (_c("return_basis") == "log") & (_c("status") == "accepted") & (_c("first") <= _c("last")) & (_c("observations") >= 1)}, _c("name"))
    side = F.when(_c("timing_domain") == "source_close", "source").otherwise("target")
    held = rows.withColumn("side", side).join(s.schedules.select("study", "side", "session"), ["study", "side"], "left")
    inside = _c("session").between(_c("first"), _c("last"))
    held = held.groupBy("study", "name", "observations").agg(F.count(F.when(inside, 1)).alias("n"), F.count(F.when(_c("session") == _c("first"), 1)).alias("a"), F.count(F.when(_c("session") == _c("last"), 1)).alias("b"))
    out = out.unionByName(_told(held, {"L4": (_c("n") == _c("observations")) & (_c("a") == 1) & (_c("b") == 1)}, _c("name")))
    distinct = rows.where("name <> 'target_intraday'")
    again = distinct.groupBy("study", "manifest").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name")).where("n > 1")
    main = rows.where("name IN ('driver', 'target_gap')").select("study", "bars").distinct()
    clones = rows.where("p IS NULL").join(main, ["study", "bars"], "left_semi")
    both = again.select("study", "name").unionByName(clones.select("study", "name")).distinct()
    return out.unionByName(both.select("study", F.lit("L5").alias("rule"), _c("name").alias("at")))


def session_problems(s: Sealed) -> DataFrame:
    """L3: the sealed session map against the one that the schedules give, as a symmetric difference of links."""
    source = s.schedules.where("side = 'source'").select("study", _c("session").alias("source_session"), "close_at")
    target = s.schedules.where("side = 'target'").select("study", _c("session").alias("target_session"), "open_at")
    hit = asof.forward(source, target, ["study"], "close_at", "open_at", "target_session", "month").where("target_session IS NOT NULL")
    latest = hit.groupBy("study", "target_session").agg(F.max_by("source_session", "close_at").alias("source_session"))
    one, other = latest.select("study", "target_session", "source_session"), s.links.select("study", "target_session", "source_session")
    differ = one.exceptAll(other).unionByName(other.exceptAll(one)).select("study", "target_session").distinct()
    return differ.select("study", F.lit("L3").alias("rule"), _c("target_session").alias("at"))


def evidence_problems(s: Sealed, families: Mapping[str, str], statuses: tuple[str, ...] = ("supports", "inconclusive", "falsifies")) -> DataFrame:
    """L6: flags have a proper code once a session, start on a target session and end on a later one; diagnostics are of known families, once each,
    with their role and a known state, of a target session that is not after the evaluation."""
    sessions = s.schedules.where("side = 'target'").select("study", "session")
    at = lambda df, column: df.join(sessions.withColumnRenamed("session", column).withColumn(f"has_{column}", F.lit(True)), ["study", column], "left")
    flags = at(at(s.flags, "effective"), "resolved").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("study", "effective", "code")))
    ok = _c("code").rlike(CODE) & _c("has_effective") & (_c("times") == 1) & (_c("resolved").isNull() | (_c("has_resolved") & (_c("resolved") > _c("effective"))))
    role = F.try_element_at(F.create_map(*[F.lit(x) for kv in families.items() for x in kv]), _c("family"))
    told = at(s.diagnostics, "as_of").join(s.studies.select("study", "evaluation"), "study").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("study", "family")))
    known = (role == _c("role")) & _c("status").isin(*statuses) & _c("has_as_of") & (_c("as_of") <= _c("evaluation")) & (_c("times") == 1)
    return _told(flags, {"L6": ok}, _c("code")).unionByName(_told(told, {"L6": known}, _c("family"))).distinct()


def _positions(s: Sealed) -> DataFrame:
    """(study, pos, session, usable): target sessions of the observed stretch from 0, and whether a regression can be based on them: linked to a source
    session of the driver, with a target session before it that has a gap, and controls that reach to the session that each goes by."""
    rng = s.lineages.select("study", "name", "first", "last", "timing_domain")
    own = lambda name: rng.where(_c("name") == name).select("study", _c("first").alias(f"{name}_first"), _c("last").alias(f"{name}_last"))
    controls = rng.where(~_c("name").isin(*PRIMARY)).groupBy("study", "timing_domain").agg(F.max("first").alias("first"), F.min("last").alias("last"))
    bound = lambda domain, name: controls.where(_c("timing_domain") == domain).select("study", _c("first").alias(f"{name}_first"), _c("last").alias(f"{name}_last"))
    rows = s.schedules.where("side = 'target'").select("study", "session").join(own("target_intraday"), "study").where("session BETWEEN target_intraday_first AND target_intraday_last")
    w = Window.partitionBy("study").orderBy("session")
    rows = rows.withColumns({"pos": F.row_number().over(w) - 1, "before": F.lag("session").over(w)})
    rows = rows.join(s.links.select("study", _c("target_session").alias("session"), _c("source_session").alias("source")), ["study", "session"], "left")
    for side in (own("driver"), own("target_gap"), bound("source_close", "sc"), bound("target_previous_close", "tc")):
        rows = rows.join(side, "study", "left")
    free = lambda x, name: _c(f"{name}_first").isNull() | x.between(_c(f"{name}_first"), _c(f"{name}_last"))
    usable = _c("before").isNotNull() & _c("source").between(_c("driver_first"), _c("driver_last")) & _c("before").between(_c("target_gap_first"), _c("target_gap_last")) & free(_c("source"), "sc") & free(_c("before"), "tc")
    return rows.select("study", "pos", "session", F.coalesce(usable, F.lit(False)).alias("usable"))


def member_table(s: Sealed, policy: Policy) -> DataFrame:
    """(study, window, horizon, x_…): what a member's counts must be: x_expected, x_usable, x_first, x_last, x_required, x_parameters, x_adjacent, x_predictions."""
    spark = s.studies.sparkSession
    specs = spark.createDataFrame([(w, h) for w in WINDOWS for h in HORIZONS], "window int, horizon int")
    so_far = Window.partitionBy("study").orderBy("pos")
    at = _positions(s).withColumn("sum", F.sum(_c("usable").cast("int")).over(so_far))
    per = at.groupBy("study").agg(F.sort_array(F.collect_list(F.struct("pos", "session", "usable", "sum"))).alias("a"))  # one row a session
    k = s.lineages.groupBy("study").agg((3 + F.count(F.when(~_c("name").isin(*PRIMARY), 1))).alias("x_parameters"))
    rows = per.join(k, "study").crossJoin(F.broadcast(specs)).withColumns({"from": F.size("a") - _c("window"), "to": F.size("a") - _c("horizon")})
    rows = rows.withColumns({
        "x_expected": F.when(_c("from") < 0, 0).otherwise(F.greatest(F.lit(0), _c("window") - _c("horizon") + 1)), "train": F.greatest(F.lit(policy.oos_train), policy.per_parameter * _c("x_parameters")),
        "x_required": F.greatest(F.lit(policy.min_observations), policy.per_parameter * _c("x_parameters")),
    })
    upto = lambda i: f"if({i} < 0, 0, get(a, {i}).sum)"
    rows = rows.withColumn("base", F.expr("if(from < 0 or to < from, slice(a, 1, 0), filter(slice(a, from + 1, to - from + 1), x -> x.usable))"))
    out = {
        "x_usable": "size(base)", "x_first": "get(base, 0).session", "x_last": "get(base, size(base) - 1).session",
        "x_adjacent": f"if(from < {policy.shift}, 0, {upto(f'to - {policy.shift}')} - {upto(f'from - {policy.shift} - 1')})",
        "x_predictions": f"size(filter(base, x -> {upto(f'cast(x.pos - {policy.embargo} - horizon as int)')} - {upto('from - 1')} >= train))",
    }
    return rows.select("study", "window", "horizon", "x_expected", "x_required", "x_parameters", *[F.expr(e).alias(n) for n, e in out.items()])


def member_problems(s: Sealed, policy: Policy) -> DataFrame:
    """L7 to L12 of each member, from its own sealed values and ``member_table``."""
    evaluated = s.studies.select("study", "evaluation")
    active = s.flags.join(evaluated, "study").where("effective <= evaluation AND (resolved IS NULL OR evaluation < resolved)").groupBy("study").agg(F.collect_set("code").alias("codes"))
    against = s.diagnostics.groupBy("study").agg(F.max(_c("status") == "falsifies").alias("falsified"))
    has_controls = s.lineages.groupBy("study").agg((F.count(F.when(~_c("name").isin(*PRIMARY), 1)) > 0).alias("controlled"))
    r = s.results.join(member_table(s, policy), ["study", "window", "horizon"]).join(evaluated, "study").join(active, "study", "left").join(against, "study", "left").join(has_controls, "study", "left")
    c = _c
    known, none = (lambda *n: F.forall(F.array(*[c(x).isNotNull() for x in n]), lambda v: v)), (lambda *n: F.forall(F.array(*[c(x).isNull() for x in n]), lambda v: v))
    yes = lambda x: F.coalesce(x, F.lit(False))
    grid = lambda p: (p > 0) & (F.abs(p * (policy.repetitions + 1) - F.rint(p * (policy.repetitions + 1))) <= 1e-10)
    oos, cut, estimates = ("oos_full", "oos_null", "oos_gain"), ("break_p", "break_first", "break_second"), ("driver", "standardized", "low", "high")
    r = r.withColumn("identified", (c("usable") >= c("required")) & known(*estimates))
    same = yes(c("driver") * c("adjacent") > 0)
    gain = F.when(c("oos_null") <= 0, 0.0).otherwise(1 - F.try_divide("oos_full", "oos_null"))
    passed_oos = yes((c("oos_n") >= policy.oos_predictions) & (c("oos_null") > 0) & (c("oos_gain") >= policy.oos_gain))
    passed_break = yes((c("break_p") >= policy.break_alpha) & (c("break_first") * c("break_second") > 0) & (c("driver") * c("break_first") > 0))
    unidentified = (c("raw_p") == 1.0) & none("adjacent", *oos, *cut) & ~c("same_direction") & (c("oos_n") == 0) & ~c("break_passed")
    signs = ((c("driver") == 0) == (c("standardized") == 0)) & (c("driver") * c("standardized") >= 0)
    sessions = ("recalibration", "half_life_session", "maximum")
    gates = {
        "sample_size": c("identified"), "bootstrap_interval": yes((c("low") > 0) | (c("high") < 0)), "family_wide_fdr": yes(c("q_value") <= policy.fdr_alpha), "standardized_magnitude": yes(F.abs("standardized") >= policy.min_standardized),
        "purged_embargoed_oos": c("oos_passed"), "adjacent_window_drift": c("same_direction"), "no_detected_structural_break": c("break_passed"), "not_expired_at_historical_evaluation": c("not_expired"),
        "preregistered_controls": yes(c("controlled")), "global_search_family_registered": F.lit(policy.registered), "preregistration_bound": F.lit(policy.registered),
        "no_active_point_in_time_invalidation": c("codes").isNull(), "no_auxiliary_falsification": ~yes(c("falsified")),
    }
    equal_gates = (F.size("gates") == len(gates)) & F.forall(F.array(*[yes(F.try_element_at("gates", F.lit(g)) == v) for g, v in gates.items()]), lambda v: v)
    every = F.forall(F.array(*[v for g, v in gates.items() if not g.startswith("no_a")]), lambda v: v)
    primary = F.when(every, "accepted").when(~c("identified") | c("expiry").isNull(), "quarantined").when(c("expired"), "expired").otherwise("descriptive_only")
    status = F.when(c("codes").isNotNull(), "invalidated").when((primary == "accepted") & yes(c("falsified")), "descriptive_only").otherwise(primary)
    why = [F.when(c("identified") & ~gates[g], F.lit(reason)) for g, reason in REASONS.items()]
    why += [
        F.lit("current_shock_not_applied"), F.when(c("usable") < c("required"), "insufficient_observations").when(~c("identified"), "model_not_identified"),
        F.when(~c("not_expired"), F.when(c("expired"), "expired").otherwise("expiry_not_identified")), F.when(yes(c("falsified")), "auxiliary_falsification"),
    ]
    reasons = F.array_sort(F.concat(F.array_compact(F.array(*why)), F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda x: F.concat(F.lit("invalidation_"), x))))
    rules = {
        "L7": (c("expected") == c("x_expected")) & (c("usable") == c("x_usable")) & (c("parameters") == c("x_parameters")) & (c("required") == c("x_required")) & c("base_first").eqNullSafe(c("x_first")) & c("base_last").eqNullSafe(c("x_last")),
        "L8": (c("oos_n") <= c("x_predictions")) & (c("oos_embargo") == policy.embargo) & F.when(none(*oos), ~c("oos_passed") & (c("oos_n") < policy.oos_predictions)).otherwise(
            known(*oos) & (c("oos_n") >= policy.oos_predictions) & _close(c("oos_gain"), gain, 1e-12) & (c("oos_passed") == passed_oos)),
        "L9": (c("break_split") == F.floor(c("usable") / 2)) & F.when(none(*cut), ~c("break_passed")).otherwise(known(*cut) & yes(grid(c("break_p"))) & (c("break_passed") == passed_break)),
        "L10": F.when(c("expiry").isNull(), none(*sessions) & ~c("expired") & ~c("not_expired")).otherwise(
            known(*sessions) & (c("expiry") == F.least(*sessions)) & (c("expired") == (c("evaluation") > c("expiry"))) & (c("not_expired") == ~c("expired"))),
        "L11": yes(grid(c("raw_p"))) & (c("adjacent_shift") == policy.shift) & (c("same_direction") == same) & F.when(c("identified"), signs).otherwise(none(*estimates) & unidentified)
        & (c("adjacent").isNotNull() == (c("identified") & (c("x_adjacent") >= c("required")))) & (c("low").isNull() | (c("low") <= c("high"))),
        "L12": equal_gates & (c("primary_status") == primary) & (c("statistical_status") == status) & (c("reasons") == reasons),
    }
    return _told(r, rules, _member())


def family_problems(s: Sealed, policy: Policy) -> DataFrame:
    """L13 (the family is covered once each), L14 (outcomes of one design agree), L15 (family-wide q-values), L16 (half-lives, expiry sessions, counts and the overall status)."""
    spark = s.studies.sparkSession
    every = s.studies.select("study").crossJoin(F.broadcast(spark.createDataFrame([(w, o, h) for w in WINDOWS for o in OUTCOMES for h in HORIZONS], "window int, outcome string, horizon int")))
    times = s.results.groupBy(*_KEY).count()
    cover = every.join(times, _KEY, "left").where("count IS NULL OR count > 1").unionByName(times.join(every, _KEY, "left_anti"), allowMissingColumns=True)
    out = cover.select("study", F.lit("L13").alias("rule"), _member().alias("at"))

    r = s.results.withColumn("identified", (_c("usable") >= _c("required")) & _c("driver").isNotNull() & _c("standardized").isNotNull() & _c("low").isNotNull())
    scale = F.when(~_c("identified"), 0.0).otherwise(F.pow(F.try_divide("driver", "standardized"), 2))
    shape = F.when(_c("identified"), F.concat(*[_c(x).isNull().cast("string") for x in ("break_p", "break_first", "break_second")]))
    sums, norms = ("driver", "adjacent", "break_first", "break_second"), ("scale", "oos_full", "oos_null")
    r = r.withColumns({"scale": scale, "shape": shape})
    pick = lambda column, outcome: F.max(F.when(_c("outcome") == outcome, _c(column))).alias(f"{column}_{outcome}")
    flat = r.groupBy("study", "window", "horizon").agg(
        F.count_distinct("shape").alias("shapes"), F.count_distinct(F.when(_c("identified"), _c("oos_n"))).alias("sizes"), F.max(_c("identified") & _c("scale").isNull()).alias("unknown"), *[pick(x, o) for x in (*sums, *norms) for o in OUTCOMES]
    )
    def together(name: str, test: Column) -> Column:
        parts = [_c(f"{name}_{o}") for o in OUTCOMES]
        missing = sum((p.isNull().cast("int") for p in parts[1:]), parts[0].isNull().cast("int"))
        return F.when(missing == 3, True).when(missing > 1, False).otherwise(test)

    def near(*values: Column) -> Column:
        return F.greatest(F.lit(1e-12), 1e-10 * F.greatest(F.lit(1.0), *[F.abs(v) for v in values]))

    def added(name: str) -> Column:
        g, i, t = (F.coalesce(f"{name}_{o}", F.lit(0.0)) for o in ("gap", "intraday", "total"))
        return together(name, F.abs(t - (g + i)) <= near(g, i, t))

    def normed(name: str) -> Column:
        g, i, t = (F.sqrt(F.coalesce(f"{name}_{o}", F.lit(0.0))) for o in ("gap", "intraday", "total"))
        return together(name, t.between(F.abs(g - i) - near(g, i, t), g + i + near(g, i, t)))

    agree = (_c("shapes") <= 1) & (_c("sizes") <= 1) & (_c("unknown") | normed("scale"))
    for name in norms[1:]:
        agree = agree & normed(name)
    for name in sums:
        agree = agree & added(name)
    out = out.unionByName(_told(flat, {"L14": agree}, F.concat_ws("/", "window", "horizon")))

    up, down = Window.partitionBy("study").orderBy("raw_p", "window", "outcome", "horizon"), Window.partitionBy("study").orderBy(F.desc("place"))
    ranked = s.results.select(*_KEY, "raw_p", "q_value", F.row_number().over(up).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("study")).alias("n"))
    step = ranked.withColumn("q", F.least(F.lit(1.0), F.min(_c("raw_p") * _c("n") / _c("place")).over(down)))
    out = out.unionByName(_told(step, {"L15": _close(_c("q_value"), _c("q"), 1e-12)}, _member()))

    keyed = r.select("study", F.concat_ws("|", "study", "window").alias("window"), "outcome", "horizon", F.when(_c("identified"), _c("driver")).alias("coefficient"))
    lives = half_life(keyed).select(F.split("window", "\\|")[0].alias("of"), F.split("window", "\\|")[1].cast("int").alias("window"), "outcome", _c("half_life").alias("x_half_life"))
    target = s.schedules.where("side = 'target'").select("study", "session", F.row_number().over(Window.partitionBy("study").orderBy("session")).alias("pos"))
    here = target.join(s.studies.select("study", _c("estimation").alias("session")), ["study", "session"]).select("study", _c("pos").alias("here"))
    ends = target.groupBy("study").agg(F.max("pos").alias("most")).join(here, "study")
    steps = F.when(_c("x_half_life").isNotNull(), F.least(F.greatest(F.lit(1), F.ceil(2 * _c("x_half_life"))), F.lit(policy.validity)).cast("int"))
    rows = s.results.join(lives, (s.results["study"].cast("string") == lives["of"]) & (s.results["window"] == lives["window"]) & (s.results["outcome"] == lives["outcome"])).drop(lives["window"]).drop(lives["outcome"]).join(ends, "study").withColumn("steps", steps)
    fits = _c("steps").isNotNull() & (_c("here") + F.greatest(F.lit(policy.recalibration), F.lit(policy.validity), F.coalesce("steps", F.lit(0))) <= _c("most"))
    near_by = target.join(here, "study").where(_c("pos").between(_c("here") + 1, _c("here") + max(policy.recalibration, policy.validity))).groupBy("study").agg(F.map_from_entries(F.collect_list(F.struct((_c("pos") - _c("here")).cast("int"), "session"))).alias("ahead"))
    rows = rows.join(near_by, "study", "left")
    session = lambda n: F.when(fits, F.try_element_at("ahead", n))
    life = _close(_c("half_life"), _c("x_half_life")) & _c("recalibration").eqNullSafe(session(F.lit(policy.recalibration))) & _c("half_life_session").eqNullSafe(session(_c("steps"))) & _c("maximum").eqNullSafe(session(F.lit(policy.validity)))
    out = out.unionByName(_told(rows, {"L16": life}, _member()))

    statuses = s.studies.select("study").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in LADDER], "status string")))
    own = s.results.groupBy("study", _c("statistical_status").alias("status")).count()
    tally = statuses.join(own, ["study", "status"], "left").fillna(0, ["count"]).join(s.counts, ["study", "status"], "left")
    out = out.unionByName(_told(tally, {"L16": _c("n") == _c("count")}, F.concat(F.lit("count/"), _c("status"))))
    per = tally.groupBy("study").agg(F.map_from_entries(F.collect_list(F.struct("status", "count"))).alias("m"), F.sum("count").alias("total")).join(s.studies.select("study", "overall"), "study")
    whole = F.coalesce(F.when(_c("m")["accepted"] > 0, "accepted_associations"), *[F.when(_c("m")[x] == _c("total"), x) for x in ("invalidated", "expired", "quarantined")], F.lit("descriptive_only"))
    return out.unionByName(_told(per, {"L16": _c("overall") == whole}, F.lit("overall")))


def violations(s: Sealed, parts: Mapping[str, str], families: Mapping[str, str], policy: Policy = Policy()) -> DataFrame:
    """(study, rule, at): one row for each rule that a sealed study breaks and where; none for a study that replays.

    Each set of rules is a query of its own, whose rows are written. Sealed tables are joined by merges: they repeat themselves, so that their files are far smaller than their rows.
    """
    s = Sealed(**{f.name: getattr(s, f.name).hint("merge") for f in fields(s)})
    sets = (lambda: contract_problems(s, parts), lambda: lineage_problems(s), lambda: session_problems(s), lambda: evidence_problems(s, families), lambda: member_problems(s, policy), lambda: family_problems(s, policy))
    out, *others = [stored(rules(), "violations") for rules in sets]
    for more in others:
        out = out.unionByName(more)
    return out.select(_c("study").cast("long").alias("study"), "rule", "at")
