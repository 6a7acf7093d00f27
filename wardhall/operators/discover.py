"""What a principal may know about the database, from the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(meta: dict[str, DataFrame]) -> DataFrame:
    """The newest build's number, as one row."""
    return meta["builds"].agg(F.max("build_id").alias("build_id"))


def _of_latest(meta: dict[str, DataFrame], name: str) -> DataFrame:
    return meta[name].join(F.broadcast(latest(meta)), "build_id", "left_semi")  # one row


def schemas(meta: dict[str, DataFrame], principal: str) -> DataFrame:
    granted = _of_latest(meta, "role_schemas").filter((F.col("role_name") == principal) & F.col("usage")).select(F.col("schema_name").alias("name"))
    return _of_latest(meta, "schemas").join(granted, "name").select("name", "description", "clearance").orderBy("name")


def tables(meta: dict[str, DataFrame], principal: str, schema: str | None = None) -> DataFrame:
    granted = _of_latest(meta, "role_tables").filter((F.col("role_name") == principal) & F.col("select")).select("schema_name", F.col("table_name").alias("name"))
    role = _of_latest(meta, "roles").filter(F.col("name") == principal).select(F.col("clearance").alias("most"))
    out = _of_latest(meta, "tables").join(granted, ["schema_name", "name"]).join(role, F.col("clearance") <= F.col("most"))
    out = out if schema is None else out.filter(F.col("schema_name") == schema)
    return out.select("schema_name", "name", "description", "clearance").orderBy("schema_name", "name")


def columns(meta: dict[str, DataFrame], principal: str, schema: str | None = None, table: str | None = None) -> DataFrame:
    granted = _of_latest(meta, "role_tables").filter((F.col("role_name") == principal) & F.col("select")).select("schema_name", "table_name")
    role = _of_latest(meta, "roles").filter(F.col("name") == principal).select(F.col("clearance").alias("most"), "can_access_sensitive")
    out = _of_latest(meta, "columns").join(granted, ["schema_name", "table_name"]).join(role, (F.col("clearance") <= F.col("most")) & (~F.col("sensitive") | F.col("can_access_sensitive")))
    for name, value in (("schema_name", schema), ("table_name", table)):
        out = out if value is None else out.filter(F.col(name) == value)
    return out.select("schema_name", "table_name", "name", "type", "description", "clearance", "masking_strategy").orderBy("schema_name", "table_name", "name")


def roles(meta: dict[str, DataFrame], principal: str) -> DataFrame:
    """The principal's own row, or every role's if it is an administrator."""
    every = _of_latest(meta, "roles")
    admin = every.filter((F.col("name") == principal) & F.col("can_admin")).select(F.lit(True).alias("all")).limit(1)
    own = every.filter(F.col("name") == principal)
    return every.join(admin, F.lit(True), "left_semi").unionByName(own).dropDuplicates(["name"]).select("name", "description", "clearance", "can_login", "can_admin", "member_of").orderBy("name")


def listed(df: DataFrame, by: str, what: str, name: str) -> DataFrame:
    """The different values of each group as one text, in order."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(what)), ", ").alias(name))


def members(meta: dict[str, DataFrame]) -> DataFrame:
    """Roles that have members, with those as one text."""
    links = _of_latest(meta, "roles").select(F.explode("member_of").alias("role_name"), F.col("name").alias("member"))
    return listed(links, "role_name", "member", "members")


def clearances(meta: dict[str, DataFrame]) -> DataFrame:
    """Least and greatest clearance of each table's columns; 0 where none is set."""
    return _of_latest(meta, "columns").groupBy("schema_name", "table_name").agg(F.coalesce(F.min("clearance"), F.lit(0)).alias("least"), F.coalesce(F.max("clearance"), F.lit(0)).alias("most"))


def as_json(df: DataFrame, what: str) -> DataFrame:
    """One row with a JSON array, ordered by the columns, or a message where there is nothing."""
    found = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("rows"))
    return found.select(F.when(F.size("rows") > 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.lit(f"No results found for {what}").alias("message")))).alias("json"))


def context(meta: dict[str, DataFrame], principal: str) -> dict[str, list[dict]]:
    """All four, collected: metadata is as large as the specification, not as the data."""
    found = {"schemas": schemas, "tables": tables, "columns": columns, "roles": roles}
    return {n: [r.asDict(recursive=True) for r in f(meta, principal).collect()] for n, f in found.items()}
