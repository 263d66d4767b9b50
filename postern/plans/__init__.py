"""Registered queries of the message engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postern.plans import mail, outlook, records, relational

QUERIES = mail.QUERIES | outlook.QUERIES | records.QUERIES | relational.QUERIES
SQL = mail.SQL | outlook.SQL | records.SQL | relational.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.messages_by_sender(spark, sf_dir)
