"""The executive report: named DataFrames over one written input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators import charts, kpi, models, roles, rootcause
from dataprobe.operators.profile import best_target, profile
from dataprobe.operators.quality import quality_report
from dataprobe.scratch import materialise


def findings(name: str, columns: int, quality: DataFrame, narrative: DataFrame) -> DataFrame:
    """``place, finding``: size, quality, what happened, why."""
    q, n = F.broadcast(quality.select("quality_score", "total_rows")), F.broadcast(narrative)
    row = q.crossJoin(n)
    texts = [
        F.concat(F.lit(f"Dataset '{name}': "), F.format_number("total_rows", 0), F.lit(f" rows, {columns} columns.")),
        F.format_string("Data quality score is %d of 100.", "quality_score"),
        F.concat(F.lit("Root cause: "), F.col("what_happened")),
        F.concat(F.lit("Driver: "), F.col("why_it_happened")),
    ]
    structs = [F.struct(F.lit(i + 1).alias("place"), t.alias("finding")) for i, t in enumerate(texts)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def executive_report(
    df: DataFrame, name: str, order_by: list[str], *, target: str | None = None, ts: str | None = None, start=None, end=None,
    with_models: bool = True, exact: bool = True,
) -> dict[str, DataFrame]:
    """Key figures, quality, root cause, drivers, charts and key findings.

    The input is written once; every part reads only its own columns from there. ``exact`` goes to the profile.
    """
    base = materialise(df, "report")
    profiles = materialise(profile(base, exact), "report-profile")
    quality = materialise(quality_report(base, profiles), "report-quality")
    target = target or best_target(profiles) or roles.root_cause_target(base)
    ts = ts or roles.date_column(base)
    out = {"quality": quality, "profiles": profiles, "kpis": kpi.kpi_table_by_role(base, ts)}
    cause = rootcause.explain(base, target, order_by, ts, start, end)
    out |= {f"root_cause_{k}": v for k, v in cause.items()}
    out["findings"] = findings(name, len(df.columns), quality, cause["narrative"])
    if with_models:
        out["drivers"], out["driver_scores"] = models.target_drivers(base, target, key=order_by)
    out |= {f"chart_{k}": v for k, v in charts.automatic(base, order_by).items()}
    return out
