"""Extraction and graph quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions import text as T
from loomgraph.operators import traverse

KEY = ("subject", "relation", "object")


def triple_set(triples: DataFrame, by_node: bool = False) -> DataFrame:
    """Distinct triples in a form for comparison: entities in lower case,
    relations in upper case, all stripped, none empty.  ``by_node`` compares
    node keys, so that labels and keys of one entity are equal."""
    s, o = (T.node_id(F.col(c)) if by_node else F.lower(F.trim(c)) for c in ("subject", "object"))
    rows = triples.select(s.alias("subject"), F.upper(F.trim("relation")).alias("relation"), o.alias("object"))
    return rows.where((F.length("subject") > 0) & (F.length("relation") > 0) & (F.length("object") > 0)).distinct()


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def compare(predicted: DataFrame, gold: DataFrame, by_node: bool = False) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall,
    F1 and agreement (Jaccard); 0 where a denominator is 0.  One shuffle: both
    sides are counted per triple."""
    p = triple_set(predicted, by_node).withColumn("p", F.lit(1)).withColumn("g", F.lit(0))
    g = triple_set(gold, by_node).withColumn("p", F.lit(0)).withColumn("g", F.lit(1))
    per = p.unionByName(g).groupBy(*KEY).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    one = per.agg(
        F.count_if((F.col("p") == 1) & (F.col("g") == 1)).alias("tp"), F.count_if((F.col("p") == 1) & (F.col("g") == 0)).alias("fp"), F.count_if((F.col("p") == 0) & (F.col("g") == 1)).alias("fn"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    one = one.withColumn("precision", precision).withColumn("recall", recall)
    one = one.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return one.withColumn("agreement", _ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))


def graph_quality(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row of graph metrics."""
    g = traverse.graph_statistics(node_rows, edge_rows)
    c = edge_rows.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), _ratio(F.count_if(F.col("confidence") >= 0.8), F.count(F.lit(1))).alias("high_confidence_ratio"))
    n = F.col("num_nodes")
    return g.crossJoin(c).select(  # one row each
        n.alias("unique_entities"), F.col("num_edges").alias("total_triples"), F.col("num_relations").alias("total_relations"), F.col("density").alias("graph_density"),
        F.coalesce("avg_degree", F.lit(0.0)).alias("avg_node_degree"), _ratio(F.col("largest_component"), n).alias("connectivity"), _ratio(F.col("covered"), n).alias("coverage"), "avg_confidence", "high_confidence_ratio",
    )


def full_evaluation(triples: DataFrame, gold: DataFrame, node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: graph metrics and extraction scores.  Both sides are compared
    by node key, so names of several words can match."""
    scores = compare(triples, gold, by_node=True).select("precision", "recall", "f1", "agreement")
    return graph_quality(node_rows, edge_rows).crossJoin(scores)


def advice(metrics: DataFrame) -> DataFrame:
    """Metrics with ``advice``: a line for each that falls short."""
    lines = F.array_compact(F.array(
        F.when(F.col("graph_density") < 0.01, "Low graph density: extract more relations"),
        F.when(F.col("connectivity") < 0.5, "Low connectivity: link separate components"),
        F.when(F.col("coverage") < 0.7, "Low coverage: many concepts have no connection"),
    ))
    return metrics.withColumn("advice", F.array_join(lines, "\n"))


@F.pandas_udf(StringType())
def shown(numbers: pd.Series) -> pd.Series:
    """Doubles by their shortest digits, with an exponent only below 1e-4 and from 1e16 on."""
    return numbers.map(lambda x: repr(float(x)))


def report(metrics: DataFrame) -> DataFrame:
    """The metrics as one text (column ``value``)."""
    fields = [c for c in metrics.columns]
    as_text = lambda c: F.when(F.col(c).isNotNull(), shown(c)) if metrics.schema[c].dataType.typeName() == "double" else F.col(c).cast("string")
    lines = [F.concat(F.lit(f"{c}: "), as_text(c)) for c in fields]
    return advice(metrics).select(F.concat_ws("\n", F.lit("Evaluation"), *lines, F.nullif(F.col("advice"), F.lit(""))).alias("value"))
