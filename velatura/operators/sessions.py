"""Sessions of a run: found by id or composite name, created once, updated by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.sources.sinks import VersionedTable

SESSION = "id long, nome_identificador string, status string, tag_ini string, tag_fim string, atualizado_em timestamp"


def composite_name(name: str, model: str) -> str:
    return f"{name} [{model}]"


def store(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, SESSION, ["id"], buckets=4)


def by_id(sessions: DataFrame, session: int) -> DataFrame:
    """The session's row, or none."""
    return sessions.where(F.col("id") == session)


def tag_characters(sessions: DataFrame, session: int) -> tuple[str | None, str | None]:
    """The two tag characters; (None, None) where they aren't set or there is no such session."""
    row = by_id(sessions, session).select("tag_ini", "tag_fim").first()
    return (row.tag_ini, row.tag_fim) if row else (None, None)


def find(table: VersionedTable, name: str, model: str) -> int:
    """Id of the session of that name, touched; -1 if there is none."""
    full = composite_name(name, model)
    row = table.read().where(F.col("nome_identificador") == full).agg(F.min("id").alias("id")).first()
    if row.id is None:
        return -1
    update(table, row.id)
    return row.id


def get_or_create(table: VersionedTable, name: str, model: str, status: str = "iniciado") -> int:
    """Id of the session of that name; a new one gets the next id."""
    found = find(table, name, model)
    if found >= 0:
        return found
    new = (table.read().agg(F.max("id")).first()[0] or 0) + 1
    table.insert_absent(_row(table.spark, new, nome_identificador=composite_name(name, model), status=status))
    return new


def update(table: VersionedTable, session: int, status: str | None = None, tags: tuple[str, str] | None = None) -> None:
    """Sets what is given, and the time."""
    ini, fim = tags or (None, None)
    table.upsert(_row(table.spark, session, status=status, tag_ini=ini, tag_fim=fim))


def _row(spark: SparkSession, session: int, **values) -> DataFrame:
    names = ["nome_identificador", "status", "tag_ini", "tag_fim"]
    row = spark.createDataFrame([(session, *[values.get(n) for n in names])], "id long, " + ", ".join(f"{n} string" for n in names))
    return row.withColumn("atualizado_em", F.current_timestamp())
