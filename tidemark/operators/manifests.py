"""Packages and their targets from raw manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.shred import adjacency, entities, members, shred

#: Steps below ``exports`` that are followed.
MAX_STEPS = 8
#: Fields that name a target directly.
DIRECT = ("main", "module", "types")
#: Scalar fields of a package row.
PACKAGE_FIELDS = ("name", "version", "main", "module", "types")
#: Fields that list dependencies by name.
DEPENDENCY_FIELDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def manifest_nodes(manifests: DataFrame) -> DataFrame:
    """``manifest_id, nodes``: distinct (manifest_id, body), shredded. No body or no strict JSON: no row."""
    return shred(manifests.select("manifest_id", "body").where(F.col("body").isNotNull()).distinct(), "body").where(F.col("nodes").isNotNull())


def targets(manifests: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """``manifest_id, json_path, target, in_root``: each string target of a manifest with its place, once.

    Bodies that are null, no strict JSON or no object give no rows. Of a repeated key the
    last value counts. Strings more than ``steps`` below ``exports`` are no targets.

    The adjacency table's objects, with their paths, are joined with their string members, and the
    strings are pivoted into one package row: lists for ``exports`` and for each direct field. What is in the root
    follows from that row, whose lists are those of one body.
    """
    record = ["manifest_id", "record"]
    # objects carry their paths; a string lies one step below its object
    nodes = adjacency(shred(_keyed(manifests), "body", reach=steps).where(F.get("nodes", 0)["kind"] == "object"))
    root, exports = F.size("path") == 0, F.get("path", F.lit(0)) == "exports"
    dot = F.col("label").startswith(".")
    held = members(nodes, record, F.col("path").isNotNull() & (root | exports), (F.col("kind") == "string") | dot)
    field = F.when(root & F.col("label").isin("exports", *DIRECT), F.col("label")).when(exports, "exports")
    labels = F.concat("path", F.array("label"))
    top = F.when(root, F.lit(None)).otherwise(F.get(labels, F.lit(1)))
    held = held.withColumn("field", field).where(F.col("field").isNotNull())
    strings = held.select(*record, "field", F.array_join(labels, " > ").alias("json_path"), F.when(F.col("kind") == "string", F.col("scalar")).alias("target"), top.alias("top"))
    # objects and arrays whose key below exports starts with a dot decide what the root is, too
    dotted = nodes.where(F.col("kind").isin("object", "array") & (F.size("path") == 2) & exports & dot).select(*record, F.lit("exports").alias("field"), F.lit(None).cast("string").alias("json_path"), F.lit(None).cast("string").alias("target"), F.col("label").alias("top"))
    package = strings.unionByName(dotted).groupBy(*record).pivot("field", ["exports", *DIRECT]).agg(F.collect_list(F.struct("json_path", "target", "top")))
    none = F.array().cast("array<struct<json_path:string,target:string,top:string>>")
    package = package.select(*record, *[F.coalesce(c, none).alias(c) for c in ("exports", *DIRECT)])
    by_dot = F.exists("exports", lambda e: F.coalesce(e["top"].startswith("."), F.lit(False)))
    inside = F.transform("exports", lambda e: F.struct(e["json_path"].alias("json_path"), e["target"].alias("target"), (~F.col("by_dot") | F.coalesce(e["top"] == ".", F.lit(False))).alias("root")))
    inside = F.filter(inside, lambda e: e["target"].isNotNull())
    direct = F.transform(F.filter(F.concat(*DIRECT), lambda e: e["target"].isNotNull()), lambda e: F.struct(e["json_path"].alias("json_path"), e["target"].alias("target"), (~F.exists("inside", lambda x: x["root"])).alias("root")))
    rows = package.withColumn("by_dot", by_dot).withColumn("inside", inside)
    found = rows.select("manifest_id", F.inline(F.concat("inside", direct)))
    return found.select("manifest_id", "json_path", "target", F.col("root").cast("int").alias("in_root")).distinct()


def packages(manifests: DataFrame) -> DataFrame:
    """``manifest_id, name, version, main, module, types``: the root object of each manifest, scalar fields as text.

    Two different bodies of one manifest give two rows, equal rows one.
    """
    nodes = adjacency(shred(_keyed(manifests), "body").where(F.get("nodes", 0)["kind"] == "object")).where("node = 0 or parent = 0")
    return entities(nodes, ["manifest_id", "record"], PACKAGE_FIELDS).where("node = 0").select("manifest_id", *PACKAGE_FIELDS).distinct()


def dependencies(manifests: DataFrame) -> DataFrame:
    """``manifest_id, field, name, range``: declared dependencies; a field that is no object and a range that is no string give none."""
    records = manifest_nodes(manifests).where(F.get("nodes", 0)["kind"] == "object")
    owners = F.filter("nodes", lambda n: (n["parent"] == 0) & (n["kind"] == "object") & n["label"].isin(*DEPENDENCY_FIELDS))
    rows = records.select("manifest_id", "nodes", F.explode(owners).alias("owner"))
    listed = F.filter("nodes", lambda n: (n["parent"] == F.col("owner.node")) & (n["kind"] == "string"))
    return rows.select("manifest_id", F.col("owner.label").alias("field"), F.explode(listed).alias("n")).select("manifest_id", "field", F.col("n.label").alias("name"), F.col("n.scalar").alias("range")).distinct()


def _keyed(manifests: DataFrame) -> DataFrame:
    return manifests.select("manifest_id", "body").where(F.col("body").isNotNull()).distinct().withColumn("record", F.xxhash64("manifest_id", "body"))
