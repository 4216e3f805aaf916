"""Default columns by name. Schema only; every operator also takes its columns explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dataprobe.operators.shape import TEMPORAL, columns_of

# fixed values: candidate names per role, first hit wins
KPI_MONETARY = ("revenue", "sales", "total_amount", "amount", "spend", "cost", "treatment_cost", "mrr_generated", "quantity", "age")
KPI_EFFICIENCY = ("profit", "roi", "net_margin", "satisfaction_score", "discount")
KPI_RISK = ("customer_complaint", "order_cancelled", "delivery_delay_days", "readmission_30d", "churn")
CHART_METRIC = ("revenue", "profit", "sales", "mrr_generated", "spend", "cost", "treatment_cost", "quantity", "leads")
CHART_DIMENSION = ("region", "product_category", "category", "channel", "department", "segment", "customer_segment")
CHART_RISK = (
    "delivery_delay_days", "wait_time_minutes", "customer_complaint", "order_cancelled", "readmission_30d", "bounce_rate",
    "cpa", "discount",
)
CHART_RANKING = (
    "product_name", "product_id", "channel", "department", "doctor_specialty", "campaign_name", "carrier", "sub_category",
)
SERIES_METRIC = (
    "revenue", "sales", "total_amount", "amount", "treatment_cost", "spend", "cost", "mrr_generated", "profit", "price", "quantity",
)
SERIES_DATE = ("order_date", "date", "admission_date", "transaction_date", "created_at", "timestamp", "event_date", "time")
ANOMALY_METRIC = ("price", "sales", "revenue", "profit", "amount", "cost", "total", "count", "value")
RFM_ENTITY = (
    "customer_id", "customer", "customer_name", "client_id", "client", "user_id", "user", "patient_id", "patient", "member_id",
    "account_id", "account", "subscriber_id", "subscriber", "lead_id", "order_id",
    "crop", "label", "variety", "species", "category", "department", "segment", "region", "product",
)
RFM_VALUE = (
    "nitrogen", "revenue", "sales", "total_amount", "amount", "treatment_cost", "spend", "cost", "mrr_generated", "profit",
    "price", "value", "yield",
)
ROOT_CAUSE_TARGET = (
    "heartdisease", "heart_disease", "revenue", "sales", "profit", "churn", "readmission_30d", "order_cancelled", "cost",
    "target", "score", "amount",
)
RISK_LABEL = (
    "churn", "order_cancelled", "readmission_30d", "cancelled", "customer_complaint", "heartdisease", "heart_disease", "status",
    "risk", "attrition", "left", "default", "stroke",
)
CONTINUOUS_RISK = ("profit", "sales", "revenue", "amount", "margin", "income", "score", "value", "balance")
QUESTION_METRIC = ("revenue", "sales", "profit", "spend", "cost", "value", "amount", "price", "performance_score", "score")
QUESTION_RISK = ("delivery_delay_days", "wait_time_minutes", "bounce_rate", "cpa", "error_rate")
QUESTION_DIMENSION = (
    "region", "category", "channel", "segment", "department", "type", "status", "product_name", "customer_name", "state",
)
# per domain: primary metrics, risk metrics, dimensions
DOMAIN_COLUMNS = {
    "ecommerce": (
        ("revenue", "sales", "profit", "quantity", "order_value"),
        ("delivery_delay_days", "order_cancelled", "return_rate", "discount"),
        ("region", "product_category", "category", "channel", "customer_segment", "product_name", "customer_name", "state"),
    ),
    "saas": (
        ("mrr_generated", "arr", "leads", "roi", "conversions", "spend"),
        ("cpa", "bounce_rate", "churn_rate", "cac", "roi"),
        ("channel", "segment", "region", "campaign_name", "plan_type"),
    ),
    "healthcare": (
        ("treatment_cost", "length_of_stay", "wait_time_minutes", "readmission_30d"),
        ("readmission_30d", "wait_time_minutes", "length_of_stay", "mortality_rate"),
        ("department", "doctor_specialty", "admission_type", "insurance_type", "region"),
    ),
    "marketing": (
        ("spend", "impressions", "clicks", "conversions", "revenue", "roi"),
        ("cpa", "bounce_rate", "cpc", "ctr"),
        ("channel", "campaign_name", "region", "audience_segment"),
    ),
    "generic": ((), (), ()),
}
IDS = ("id", "uuid", "code")


def _named(df: DataFrame) -> dict[str, str]:
    return {c.lower().replace(" ", "_"): c for c in df.columns}


def without_ids(columns: list[str], parts=IDS) -> list[str]:
    return [c for c in columns if not any(p in c.lower() for p in parts)]


def pick(df: DataFrame, candidates, numeric: bool = False, fallback: list[str] | None = None) -> str | None:
    """The first candidate the table has; else the first of ``fallback``."""
    names, numbers = _named(df), set(columns_of(df, "numeric"))
    for c in candidates:
        if c in names and (not numeric or names[c] in numbers):
            return names[c]
    return fallback[0] if fallback else None


def series_metric(df: DataFrame) -> str | None:
    numbers = without_ids(columns_of(df, "numeric"), ("id", "uuid", "year", "code", "index"))
    return pick(df, SERIES_METRIC, numeric=True, fallback=numbers)


def date_column(df: DataFrame, parts=("date", "time")) -> str | None:
    """A known date name, else the first temporal column or name that looks like one."""
    known = pick(df, SERIES_DATE)
    if known:
        return known
    for f in df.schema:
        if isinstance(f.dataType, TEMPORAL) or any(p in f.name.lower() for p in parts):
            return f.name
    return None


def chart_roles(df: DataFrame) -> dict[str, str | None]:
    """Metric, dimension, second dimension, risk metric and ranking dimension of the automatic charts."""
    numbers, texts = without_ids(columns_of(df, "numeric")), without_ids(columns_of(df, "string"))
    metric = pick(df, CHART_METRIC, fallback=numbers)
    dim = pick(df, CHART_DIMENSION, fallback=texts)
    second = next((c for c in texts if c != dim), None)
    risk = pick(df, CHART_RISK, fallback=numbers[2:3])
    names = _named(df)
    ranking = next((names[c] for c in CHART_RANKING if c in names and names[c] not in (dim, second)), None)
    if ranking is None and texts:
        ranking = texts[-1]
    date = next(
        (f.name for f in df.schema if isinstance(f.dataType, TEMPORAL) or any(p in f.name.lower() for p in ("date", "time", "day"))), None
    )
    return {"date": date, "metric": metric, "dimension": dim, "second": second, "risk": risk, "ranking": ranking}


def rfm_roles(df: DataFrame) -> dict[str, str | None]:
    numbers = without_ids(columns_of(df, "numeric"), ("id", "uuid", "code", "year", "unnamed"))
    return {
        "entity": pick(df, RFM_ENTITY), "date": date_column(df, ("date", "time", "year")), "value": pick(df, RFM_VALUE, fallback=numbers)
    }


def question_roles(df: DataFrame, domain: str = "generic") -> dict[str, str | None]:
    metrics, risks, dims = DOMAIN_COLUMNS.get(domain, DOMAIN_COLUMNS["generic"])
    numbers, texts = columns_of(df, "numeric"), columns_of(df, "string")
    metric = pick(df, metrics + QUESTION_METRIC, fallback=numbers)
    risk = pick(df, risks + QUESTION_RISK, fallback=[c for c in numbers if c != metric] or [metric])
    return {"metric": metric, "risk": risk, "dimension": pick(df, dims + QUESTION_DIMENSION, fallback=texts)}


def root_cause_target(df: DataFrame) -> str:
    numbers = without_ids(columns_of(df, "numeric"), ("id", "uuid", "unnamed", "year"))
    return pick(df, ROOT_CAUSE_TARGET, fallback=numbers or df.columns[-1:])


def risk_source(df: DataFrame) -> str | None:
    """A class column by name, else a continuous one whose name holds a preferred word."""
    named = pick(df, RISK_LABEL)
    if named:
        return named
    parts = ("id", "uuid", "code", "year", "postal", "zip", "index", "unnamed", "row")
    numbers = without_ids(columns_of(df, "numeric"), parts)
    for word in CONTINUOUS_RISK:
        for c in numbers:
            if word in c.lower():
                return c
    return numbers[0] if numbers else None


# fixed values: name parts that mark a business domain, tested in this order
DOMAIN_WORDS = {
    "hospitality": (
        "neighbourhood", "neighborhood", "room_type", "listing", "host_name", "host_id", "property_type", "accommodates", "bed",
        "minimum_nights", "airbnb",
    ),
    "healthcare": (
        "heart", "cardio", "disease", "patient", "blood_pressure", "cholesterol", "readmission", "hospital", "triage", "treatment",
        "diagnosis", "glucose", "bmi",
    ),
    "marketing": ("campaign", "lead", "click", "ctr", "cpc", "cpa", "roas", "impression", "funnel", "conversion"),
    "saas": (
        "churn", "mrr", "arr", "subscriber", "subscription", "contract", "tenure", "seats", "active_user", "monthly_charges",
    ),
    "ecommerce": (
        "order", "shipping", "carrier", "sku", "cart", "product", "delivery", "fulfillment", "return_rate", "discount",
        "unit_price", "sales",
    ),
    "hr": ("employee", "salary", "attrition", "job_role", "department", "work_accident", "satisfaction", "promotion"),
    "education": ("student", "grade", "gpa", "exam", "score", "attendance", "course", "subject", "school"),
    "transportation": ("fare", "passenger", "pickup", "dropoff", "trip", "taxi", "driver", "ride"),
    "finance": ("loan", "credit", "debt", "interest", "balance", "fraud", "default"),
}


def domain_of(df: DataFrame) -> str:
    text = " ".join(df.columns).lower()
    for name, words in DOMAIN_WORDS.items():
        if any(w in text for w in words):
            return name
    return "generic"
