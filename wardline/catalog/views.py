"""Stand-ins for clinical tables, derived from the given ones.

Each view exists twice: as a DataFrame built with the library, and as SQL for the checks. Row
expressions that shape the raw input are shared text, valid in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.catalog.registry import table
from wardline.functions import clean_censored, decimal_comma
from wardline.operators.reshape import pivot_first
from wardline.operators.window import baseline_drop_label, days_since_start, sequence

ITEMS = ["click", "error", "purchase", "signup", "view"]
KEYS = ["pid", "intid"]

OBS = [
    "user_id AS pid",
    "user_id * 10 + CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS intid",
    "event_id AS ord",
    "ts",
    "CAST(ts AS DATE) AS day",
    "event_type AS item",
    "CASE WHEN event_id % 50 = 0 THEN '<8' WHEN event_id % 50 = 1 THEN 'NEG' "
    "WHEN event_id % 50 = 2 THEN replace(CAST(value AS STRING), '.', ',') "
    "WHEN event_id % 50 = 3 THEN NULL ELSE CAST(value AS STRING) END AS raw",
]
OBS2 = [
    "user_id AS pid",
    "user_id * 10 + CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS intid",
    "event_id AS ord",
    "CAST(ts AS DATE) AS day",
    "event_type AS item",
    "value AS value1",
    "value * 0.5 AS value2",
]
DEMO = [
    "c_custkey AS pid",
    "c_custkey * 10 + 1 AS intid",
    "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(15 + c_custkey % 40 AS DOUBLE) END AS age",
    "CASE WHEN c_custkey % 5 = 0 THEN 'Man' WHEN c_custkey % 5 = 1 THEN NULL ELSE 'Vrouw' END AS sex",
    "c_mktsegment AS diagnosis",
]
FEAT_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MODELS = [
    ("Isolation Forest (limit=400)", 1, 400),
    ("Isolation Forest (limit=900)", 2, 900),
    ("One-Class SVM (limit=1500)", 3, 1500),
    ("One-Class SVM (limit=900)", 4, 900),
    ("Local Outlier Factor (limit=3000)", 5, 3000),
    ("Local Outlier Factor (limit=0)", 6, 0),
]


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*OBS)


def obs_num(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).withColumn("num", clean_censored(decimal_comma("raw")))


def obs2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*OBS2)


def demo(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*DEMO)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_first(obs_num(spark, sf), [*KEYS, "day"], "item", "num", ITEMS, ["ord"])


def feat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*FEAT_KEYS, *FEATS)


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def pred(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    y = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    models = F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.lit(o).alias("ord"), F.lit(t).alias("lim")) for m, o, t in MODELS
    ])
    rows = docs.join(y, "doc_id").select("doc_id", F.col("lang").alias("config"), "y", "n_chars", F.explode(models).alias("m"))
    flag = (F.col("n_chars") < F.col("m.lim")).cast("int")
    return rows.select("config", "doc_id", "y", "m.model_id", "m.ord", flag.alias("y_pred"))


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Patient-days with sequence, day count, label, control flag and a prediction."""
    days = sequence(daily(spark, sf), KEYS, ["day"], "seq")
    days = days_since_start(days, KEYS, "day", "dsa")
    labelled = baseline_drop_label(days, KEYS, ["day"], ["purchase"], out="label")
    control = (F.col("diagnosis") == "BUILDING").cast("int")
    out = labelled.join(demo(spark, sf).select("pid", control.alias("control"), "age", "sex"), "pid", "left")
    return out.withColumn("flag", F.coalesce(F.col("view") > 60, F.lit(False)).cast("int"))


def _cell(item: str) -> str:
    return f"arg_min(num, ord) FILTER (WHERE item = '{item}') AS {item}"


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "obs": ([], f"SELECT {', '.join(OBS)} FROM events"),
    "obs2": ([], f"SELECT {', '.join(OBS2)} FROM events"),
    "demo": ([], f"SELECT {', '.join(DEMO)} FROM customer"),
    "obs_num": (
        ["obs"],
        "SELECT *, CASE WHEN raw LIKE '<%' THEN TRY_CAST(substr(raw, 2) AS DOUBLE) "
        "WHEN regexp_full_match(raw, '[[:alpha:]]+') THEN NULL "
        "ELSE TRY_CAST(replace(raw, ',', '.') AS DOUBLE) END AS num FROM obs",
    ),
    "daily": (
        ["obs_num"],
        f"SELECT pid, intid, day, {', '.join(_cell(i) for i in ITEMS)} FROM obs_num "
        "WHERE num IS NOT NULL GROUP BY pid, intid, day",
    ),
    "feat": ([], f"SELECT {', '.join(FEAT_KEYS + FEATS)} FROM lineitem"),
    "vec": ([], "SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings"),
    "pred": (
        [],
        "SELECT d.lang AS config, d.doc_id, l.toxic AS y, m.model_id, m.ord, "
        "CASE WHEN d.n_chars < m.lim THEN 1 ELSE 0 END AS y_pred "
        "FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (VALUES "
        + ", ".join(f"('{m}', {o}, {t})" for m, o, t in MODELS)
        + ") m(model_id, ord, lim)",
    ),
    "cohort": (
        ["daily", "demo"],
        "SELECT d.*, c.control, c.age, c.sex, CASE WHEN d.view > 60 THEN 1 ELSE 0 END AS flag FROM ("
        "SELECT *, row_number() OVER w AS seq, date_diff('day', min(day) OVER (PARTITION BY pid, intid), day) AS dsa, "
        "CASE WHEN row_number() OVER w > 1 AND first_value(purchase) OVER w <> 0 AND "
        "(first_value(purchase) OVER w - purchase) / first_value(purchase) OVER w * 100 >= 10 THEN 1 ELSE 0 END AS label "
        "FROM daily WINDOW w AS (PARTITION BY pid, intid ORDER BY day)) d "
        "LEFT JOIN (SELECT pid, CASE WHEN diagnosis = 'BUILDING' THEN 1 ELSE 0 END AS control, age, sex FROM demo) c "
        "USING (pid)",
    ),
}


def sql(views: str, body: str) -> str:
    """Body under a WITH clause that defines the named views and those they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL_VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for view in views.split():
        visit(view)
    return "WITH " + ", ".join(f"{v} AS ({SQL_VIEWS[v][1]})" for v in order) + " " + body
