"""Names of the layers and tables, and the session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class LakehouseConfig:
    """Where the layers live. ``catalog`` may stay empty when the session has one only."""

    catalog: str = ""
    bronze: str = "bronze_ecommerce"
    silver: str = "silver_ecommerce"
    gold: str = "gold_ecommerce"
    fmt: str = "parquet"

    def schema(self, layer: str) -> str:
        name = {"bronze": self.bronze, "silver": self.silver, "gold": self.gold}[layer]
        return f"{self.catalog}.{name}" if self.catalog else name

    def table(self, layer: str, name: str) -> str:
        return f"{self.schema(layer)}.{name}"

    def ensure_namespaces(self, spark: SparkSession) -> None:
        for layer in ("bronze", "silver", "gold"):
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema(layer)}")

    def steps(self) -> list[LayerStep]:
        """The five steps of the build with the tables each of them writes."""
        entities = ("customers", "products", "orders")
        return [
            LayerStep(
                "bronze",
                "Ingestão de dados brutos",
                tuple(self.table("bronze", e) for e in entities),
            ),
            LayerStep(
                "silver",
                "Limpeza e padronização dos dados",
                tuple(self.table("silver", e) for e in entities),
            ),
            LayerStep(
                "gold",
                "Geração de KPIs agregados",
                tuple(
                    self.table("gold", t)
                    for t in ("revenue_summary", "top_products", "top_customers", "kpis")
                ),
            ),
            LayerStep(
                "documents",
                "Geração de embeddings vetoriais",
                (self.table("gold", "embeddings_documents"),),
            ),
            LayerStep("index", "Busca de documentos", ()),
        ]


@dataclass(frozen=True)
class LayerStep:
    name: str
    description: str
    tables: tuple[str, ...]


# Split a hot key at run time even when that costs a shuffle more, which is paid only
# where a hot key was measured.
SKEW_SETTINGS = {
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings for a session somebody else made."""
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tradewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ANSI mode stays on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        **SKEW_SETTINGS,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; a cluster without it is a configuration error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):  # one process, as in tests
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="tradewell-")
        return _local_scratch[app]
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
