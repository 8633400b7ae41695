"""The warehouse load run: write, audit, publish.

Stages: geography -> customer -> seller -> product -> date -> fact, then
the denormalised fact.  A stage builds its table (surrogate keys
included, B6), writes it into a draft version and audits it; the clock of
A9 runs over all of that.  Row counts and rule violations are aggregates
observed on the write and on the read of the source, so no table is
scanned a second time for them; only uniqueness is a job of its own, over
the key columns of the table just written.  A rule that must hold and
doesn't makes the stage FAILED: the run ends, nothing is published and
the tables of the last run stay current.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import warehouse as W
from ..sources import sinks, versions
from ..sources.schemas import REQUIRED

#: Money totals of source and fact may differ by this much.
TOLERANCE = 0.01


@dataclass
class Stage:
    """One table: where it comes from, how it is built, and what must hold."""
    name: str
    table: str
    source: str
    build: Callable[[dict[str, DataFrame], versions.Draft], DataFrame]
    unique: list[str]                                            # C3 / C10
    repeats: str = Q.FAIL                                        # what rows of one key make of the stage
    must: dict[str, str] = field(default_factory=dict)           # what no row may be, as SQL: else the stage fails
    warn: dict[str, str] = field(default_factory=dict)           # what is reported
    totals: tuple[str, ...] = ()                                 # C6: measures that source and table share


def _customer(src, draft):
    geo = draft.read("dim_geography")
    return W.keyed_customer(W.dim_customer(src["customers"], geo))


def _seller(src, draft):
    return W.keyed_seller(W.dim_seller(src["sellers"], draft.read("dim_geography")))


def _fact(src, draft):
    return W.fact_sales(src, {t: draft.read(t) for t in ("dim_customer", "dim_seller", "dim_product", "dim_date")})


def _null(*cols: str) -> dict[str, str]:
    return {f"null_{c}": f"{c} IS NULL" for c in cols}


STAGES = [
    Stage("geography", "dim_geography", "geolocation", lambda src, _: W.keyed_geography(src["geolocation"]),
          ["zip_code_prefix"], must=_null("zip_code_prefix")),
    Stage("customer", "dim_customer", "customers", _customer, ["customer_id"], must=_null("customer_id"),
          warn=_null("geography_key")),
    Stage("seller", "dim_seller", "sellers", _seller, ["seller_id"], must=_null("seller_id"), warn=_null("geography_key")),
    Stage("product", "dim_product", "products", lambda src, _: W.keyed_product(W.dim_product(src["products"], src["categories"])),
          ["product_id"], must=_null("product_id"), warn=_null("product_category_name_english")),
    Stage("date", "dim_date", "orders", lambda src, _: W.dim_date(src["orders"]), ["date_key"], must=_null("date_key")),
    # a source may number the items of an order twice; what a join must not do is make more rows
    Stage("fact", "fact_sales", "order_items", _fact, ["order_id", "order_item_id"], repeats=Q.WARN,
          must={"price_negative": "price < 0", "freight_negative": "freight_value < 0", "total_negative": "total_sales_amount < 0",
                "quantity_not_positive": "quantity <= 0"},
          warn=_null("customer_key", "product_key", "seller_key", "purchase_date_key"),
          totals=("price", "freight_value")),
]


def run_stage(stage: Stage, src: dict[str, DataFrame], draft: versions.Draft, metrics: sinks.StageMetrics) -> list[tuple]:
    """Build, write and audit one table; its findings (check, dataset, key, violations, status)."""
    began = time.time()
    missing = sorted(set(REQUIRED.get(stage.source, [])) - set(src[stage.source].columns))
    if missing:   # C1, before anything is read
        metrics.record(stage.name, 0, 0, time.time() - began, len(missing), "FAILED")
        return [("schema", stage.source, ",".join(missing), len(missing), Q.FAIL)]
    seen = Observation(f"read_{stage.name}_{draft.folder[-8:]}")
    cents = {t: F.sum(F.round(F.col(t), 2).cast(W.MONEY)) for t in stage.totals}   # as the fact has them
    observed = src[stage.source].observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(t) for t, c in cents.items()])
    table = stage.build({**src, stage.source: observed}, draft)
    broken = {k: F.count_if(F.expr(c)).cast("long") for k, c in {**stage.must, **stage.warn}.items()}
    wrote = draft.write(stage.table, table, metrics=broken | {t: F.sum(t) for t in stage.totals})
    read = seen.get
    grain = Q.grain_check(draft.read(stage.table), stage.unique, stage.table).first()
    found = [(kind, stage.table, key, int(wrote[key] or 0), (level if wrote[key] else Q.PASS))
             for kind, level, rules in (("rule", Q.FAIL, stage.must), ("null_keys", Q.WARN, stage.warn)) for key in rules]
    found.append(("grain", stage.table, ",".join(stage.unique), int(grain["violations"]),
                  stage.repeats if grain["violations"] else Q.PASS))
    if stage.totals:   # C2
        extra = max(0, int(wrote.get("rows", 0)) - int(read.get("rows", 0)))
        found.append(("row_count", stage.table, "more_than_source", extra, Q.FAIL if extra else Q.PASS))
    for t in stage.totals:
        apart = abs(float(read[t] or 0) - float(wrote[t] or 0))
        found.append(("reconciliation", stage.table, t, int(apart > TOLERANCE), Q.FAIL if apart > TOLERANCE else Q.PASS))
    failed = any(f[4] == Q.FAIL for f in found)
    warnings = sum(f[3] for f in found if f[4] == Q.WARN)
    metrics.record(stage.name, int(read.get("rows", 0)), int(wrote.get("rows", 0)), time.time() - began, warnings,
                   "FAILED" if failed else "SUCCESS")
    return found


def run_load(ctx, out_dir: str, stages: list[Stage] | None = None) -> tuple[sinks.StageMetrics, list[tuple], int | None]:
    """(stage metrics, findings, published version or None)."""
    draft, metrics, findings = versions.Draft(ctx.spark, out_dir), sinks.StageMetrics(), []
    for stage in stages or STAGES:
        findings += run_stage(stage, ctx.src, draft, metrics)
        if any(f[4] == Q.FAIL for f in findings):
            return metrics, findings, None
    draft.write("fact_sales_denormalized", W.denormalize(ctx.enriched), partition_by=["year_number"])
    return metrics, findings, draft.publish()


def load_warehouse(ctx, out_dir: str, fail_on_error: bool = True) -> DataFrame:
    """The stage metrics of a run (A9); with ``fail_on_error`` a failed stage raises."""
    metrics, findings, version = run_load(ctx, out_dir)
    if version is None and fail_on_error:
        raise versions.AuditFailed("; ".join(f"{c} {d}.{k}: {n}" for c, d, k, n, s in findings if s == Q.FAIL))
    if version is not None:   # later fact queries read the written table
        ctx.memo("fact_sales", lambda: versions.read_current(ctx.spark, out_dir, "fact_sales"))
    return metrics.frame(ctx.spark)


def load_findings(ctx, out_dir: str) -> DataFrame:
    """C1-C8 as the load run applies them: a row per rule and table."""
    _, findings, _ = run_load(ctx, out_dir)
    return ctx.spark.createDataFrame(findings, "check string, dataset string, key string, violations long, status string")
