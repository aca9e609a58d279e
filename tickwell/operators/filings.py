"""Facts of filings: nested documents to rows, selectors that must match exactly one, and what was known by a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
_FACTS = f"struct<facts:map<string,map<string,struct<units:map<string,array<{_FACT}>>>>>>"
_RECENT = "struct<filings:struct<recent:struct<accessionNumber:array<string>,acceptanceDateTime:array<string>>>>"
#: Bars of a year by interval; any other counts as hourly.
PERIODS = {"1m": 525_600, "5m": 105_120, "15m": 35_040, "30m": 17_520, "1h": 8_760, "4h": 2_190, "1d": 365, "1w": 52}


def periods_per_year(interval: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in PERIODS.items() for x in (F.lit(k), F.lit(v))])[interval], F.lit(8_760))


def escaped(name: Column) -> Column:
    """A step of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def facts(documents: DataFrame, value: str = "value", entity: str = "entity") -> DataFrame:
    """One row for each reported value of documents (entity, value: JSON text), with its JSON pointer. A document that is no JSON of this form gives none."""
    rows = documents.select(F.col(entity).alias("entity"), F.from_json(F.col(value), _FACTS).alias("d"))
    rows = rows.select("entity", F.explode("d.facts").alias("taxonomy", "concepts")).select("entity", "taxonomy", F.explode("concepts").alias("concept", "c"))
    rows = rows.select("entity", "taxonomy", "concept", F.explode("c.units").alias("unit", "values")).select("entity", "taxonomy", "concept", "unit", F.posexplode("values").alias("i", "v"))
    pointer = F.concat_ws("/", F.lit("/facts"), escaped(F.col("taxonomy")), escaped(F.col("concept")), F.lit("units"), escaped(F.col("unit")), F.col("i").cast("string"))
    return rows.select("entity", "taxonomy", "concept", "unit", "v.*", pointer.alias("pointer"))


def accepted(documents: DataFrame, value: str = "value", entity: str = "entity") -> DataFrame:
    """(entity, accn, accepted_at) of submissions documents, whose two lists run in parallel."""
    rows = documents.select(F.col(entity).alias("entity"), F.from_json(F.col(value), _RECENT)["filings"]["recent"].alias("r"))
    rows = rows.select("entity", F.explode(F.arrays_zip("r.accessionNumber", "r.acceptanceDateTime")).alias("z"))
    return rows.select("entity", F.col("z.accessionNumber").alias("accn"), F.try_to_timestamp(F.col("z.acceptanceDateTime")).alias("accepted_at")).where("accn IS NOT NULL")


def select_facts(of: DataFrame, known: DataFrame, selectors: DataFrame, cutoff: str) -> DataFrame:
    """A row for each selector (name, entity, taxonomy, concept, unit, accn, form, fy, fp, end, start, scale, negate): ``value`` and ``status``.

    ok; missing: no fact matches; ambiguous: more than one does; late: accepted after the cutoff; unaccepted: its filing is not among the submissions. Start is compared null-safe, as instants have none.
    """
    keys = ["entity", "taxonomy", "concept", "unit", "accn", "form", "fy", "fp", "end"]
    s, f = selectors.alias("s"), of.alias("f")
    same = F.col("s.start").eqNullSafe(F.col("f.start"))
    for k in keys:
        same = same & (F.col(f"s.{k}") == F.col(f"f.{k}"))
    hit = s.join(f, same, "left").groupBy("s.name", "s.entity", "s.accn", "s.scale", "s.negate").agg(F.count("f.pointer").alias("n"), F.max("f.val").alias("val"), F.min("f.pointer").alias("pointer"))
    hit = hit.join(known, ["entity", "accn"], "left")
    late = F.col("accepted_at") > F.lit(cutoff).cast("timestamp")
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.col("accepted_at").isNull(), "unaccepted").when(late, "late").otherwise("ok")
    value = normalized(F.col("val"), F.col("scale"), F.col("negate"))
    return hit.withColumn("status", status).select("name", "status", F.when(F.col("status") == "ok", value).alias("value"), "pointer", "accepted_at")


def normalized(value: Column, scale: Column, negate: Column) -> Column:
    """A reported value by its scale and sign."""
    return value * F.coalesce(scale, F.lit(1.0)) * F.when(F.coalesce(negate, F.lit(False)), -1.0).otherwise(1.0)


def snapshots(spark, folder: str, wanted: DataFrame) -> DataFrame:  # noqa: ANN001
    """(path, status) for wanted (path, sha256), paths relative to ``folder``: ok, changed or missing. Only files inside the folder are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    have = files.select(F.regexp_replace("path", "^.*?" + folder.rstrip("/") + "/", "").alias("path"), F.sha2("content", 256).alias("own"))
    return wanted.join(have, "path", "left").select("path", F.when(F.col("own").isNull(), "missing").when(F.col("own") == F.col("sha256"), "ok").otherwise("changed").alias("status"))
