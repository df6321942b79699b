"""The public façade: reads bound to one instant and one caller, each returning a DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitemporal as bt
from ..operators import entities as en
from ..operators import finance as fin
from ..operators import retrieval as rt
from ..sources import projections as src


class DataApi:
    """Everything is read as it was known at as_of by this caller; an instant without a zone is refused at once.

    Methods return DataFrames over all that was asked, not one row per call: a caller with many entities joins or filters.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: datetime, tenant: str | None = None, user: str | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.session = bt.Session(as_of, tenant, user)

    def facts(self, entity: str | None = None, metric: str | None = None) -> DataFrame:
        f = self.session.table(src.fin_fact(self.spark, self.sf_dir))
        return f.filter(bt.optional("entity", entity) & bt.optional("metric", metric))

    def derived(self, kind: str, entity: str | None = None, metric: str | None = None) -> DataFrame:
        rules = {"yoy": fin.yoy, "qoq": fin.qoq, "ttm": fin.ttm, "single_quarter": fin.single_quarter}
        if kind not in rules:
            raise ValueError(f"{kind} is none of {sorted(rules)}")
        return rules[kind](self.facts(entity, metric))

    def prices(self, entity: str | None = None) -> DataFrame:
        p = src.price_daily(self.spark, self.sf_dir).withColumn("superseded_at", F.lit(None).cast("timestamp"))
        return self.session.table(p).filter(bt.optional("entity", entity))

    def trading_day(self) -> DataFrame:
        return bt.trading_day(src.price_daily(self.spark, self.sf_dir), self.session.instant)

    def rates(self, requests: DataFrame) -> DataFrame:
        known = src.fx_rate(self.spark, self.sf_dir).filter(F.col("rate_date").cast("timestamp") + F.expr("INTERVAL 75 MINUTES") <= self.session.instant)
        return fin.rate_asof(requests, known)

    def documents(self, doc_type: str | None = None) -> DataFrame:
        return self.session.table(src.document(self.spark, self.sf_dir)).filter(bt.optional("doc_type", doc_type))

    def blocks(self, doc_id: int | None = None) -> DataFrame:
        return self.session.table(src.doc_block(self.spark, self.sf_dir)).filter(bt.optional("doc_id", doc_id))

    def announcements(self) -> DataFrame:
        a = src.announcement(self.spark, self.sf_dir).withColumn("superseded_at", F.lit(None).cast("timestamp"))
        return self.session.table(a)

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """BM25 over the documents that this caller sees at the instant; the filter comes before the ranking."""
        seen = self.documents().select("doc_id", "text")
        return rt.bm25(seen, questions, k=max(rt.CANDIDATES, k)).filter(F.col("rank") <= k)

    def relations(self, edges: DataFrame, a: str, b: str, entity=None) -> DataFrame:
        return en.one_hop(edges, a, b).filter(bt.optional("entity", entity))

    def resolve(self, branches: list[DataFrame], alias: str | None = None) -> DataFrame:
        return en.resolve(branches).filter(bt.optional("alias", alias))
