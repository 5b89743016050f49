"""The tables the queries run on, as Spark loaders and as SQL relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dataset:
    """A table with its columns' semantic types and the columns that order its rows."""

    name: str
    relation: str
    columns: dict[str, str]
    order: tuple[str, ...]

    def of(self, kind: str) -> list[str]:
        return [name for name, k in self.columns.items() if k == kind]

    def position(self, column: str) -> int:
        return list(self.columns).index(column)


N, C, D, T = "numeric", "categorical", "date", "text"

ORDERS = Dataset(
    "orders",
    "orders",
    {
        "o_orderkey": N, "o_custkey": N, "o_orderstatus": C, "o_totalprice": N, "o_orderdate": D,
        "o_orderpriority": C,
    },
    ("o_orderkey",),
)
EVENTS = Dataset(
    "events",
    "events",
    {"event_id": N, "ts": D, "user_id": N, "event_type": C, "value": N, "props": C},
    ("event_id",),
)
CUSTOMER = Dataset(
    "customer",
    "customer",
    {"c_custkey": N, "c_name": T, "c_nationkey": N, "c_acctbal": N, "c_mktsegment": C},
    ("c_custkey",),
)
PART = Dataset(
    "part",
    "part",
    {"p_partkey": N, "p_name": C, "p_brand": C, "p_type": C, "p_size": N, "p_retailprice": N},
    ("p_partkey",),
)
LINEITEM = Dataset(
    "lineitem",
    "lineitem",
    {
        "l_orderkey": N, "l_partkey": N, "l_suppkey": N, "l_linenumber": N, "l_quantity": N,
        "l_extendedprice": N, "l_discount": N, "l_tax": N, "l_returnflag": C, "l_linestatus": C,
        "l_shipdate": D,
    },
    ("l_orderkey",),
)
# documents with the labels some of them have: natural gaps
LABELLED = Dataset(
    "labelled",
    "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    {"doc_id": N, "text": T, "lang": C, "source": C, "n_chars": N, "quality": N, "toxic": N},
    ("doc_id",),
)
CONVERSATIONS = Dataset(
    "conversations",
    "conversations",
    {"conv_id": N, "turn": N, "role": C, "text": T},
    ("conv_id", "turn"),
)

# columns that set off most rules; the expressions mean the same in both engines
MIXED_COLUMNS = {
    "row_no": ("o_orderkey", N),
    "falling": ("-o_orderkey", N),
    "steady": ("CAST(1000 + (o_orderkey % 2) * 0.5 AS DOUBLE)", N),
    "price": ("o_totalprice", N),
    "price_twice": ("o_totalprice * 2 + (o_orderkey % 7)", N),
    "blend": ("o_totalprice + o_orderkey * 20", N),
    "flag": ("CASE WHEN o_orderkey % 100 < 93 THEN 'yes' ELSE 'no' END", C),
    "lean": (
        "CASE WHEN o_orderkey % 100 < 75 THEN 'a' WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'c' END", C,
    ),
    "sparse": ("CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_custkey END", N),
    "patchy": ("CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderpriority END", C),
    "spiky": (
        "CASE WHEN o_orderkey % 10 = 0 THEN 100000 + o_orderkey ELSE o_orderkey % 10 END", N,
    ),
    "extreme": ("CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE o_orderkey % 5 END", N),
    "half": ("CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END", C),
    "rating": ("o_orderkey % 4", N),
    "placed": ("o_orderdate", D),
    "same": ("'one'", C),
}
MIXED = Dataset(
    "mixed",
    "(SELECT "
    + ", ".join(f"{expression} AS {name}" for name, (expression, _) in MIXED_COLUMNS.items())
    + " FROM orders)",
    {name: kind for name, (_, kind) in MIXED_COLUMNS.items()},
    ("row_no",),
)

DATASETS = (ORDERS, EVENTS, CUSTOMER, PART, LINEITEM, LABELLED, CONVERSATIONS, MIXED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, dataset: Dataset) -> DataFrame:
    if dataset is LABELLED:
        documents = table(spark, sf_dir, "documents")
        labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        return documents.join(labels, "doc_id", "left").select(*dataset.columns)
    if dataset is MIXED:
        columns = [f"{expression} AS {name}" for name, (expression, _) in MIXED_COLUMNS.items()]
        return table(spark, sf_dir, "orders").selectExpr(*columns)
    return table(spark, sf_dir, dataset.name)
