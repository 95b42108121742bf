"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

They are found in two steps. The Golay keys of ``simhash_golay`` find sets whose 64-bit SimHash differs in 4 bits or
fewer: most copies with small edits, however many there are. Those whose shingle sets are similar are linked and make
the first groups. They cannot be all: two sets of similarity 0.8 differ in about ten bits, give or take three, and a
radius that covers them lets through a share of all pairs. So the prefix filter of ``jaccard_join`` completes them and
misses none: it looks for links between these groups, and does not fetch or count what is inside one. The overlap of
each candidate is counted over the whole sets, and crowded shingles are searched as described there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.hot_join import join_facts
from tarnwork.llm.jaccard_join import BUCKET_ROWS, KEY, distinct_sets, global_order, keys, likely, linked, set_groups
from tarnwork.llm.simhash_golay import majority, near_links
from tarnwork.plans.components import connected_components
from tarnwork.plans.shared import written


def _golay_candidates(leaders: DataFrame) -> DataFrame:
    """Candidates (a, b) whose SimHash is within 4 bits: enough of them to connect all such sets."""
    prints = leaders.where("n > 0").select("set_id", "fp")
    firsts = written(prints.groupBy("fp").agg(F.min("set_id").alias("first")), "prints-by-simhash")
    equal = prints.join(firsts, "fp").where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    side = lambda end: firsts.select(F.col("fp").alias(f"fp_{end}"), F.col("first").alias(end))
    links = near_links(firsts).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return equal.unionByName(links.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b"))


def simhash_groups(rows: DataFrame, leaders: DataFrame, order) -> DataFrame:
    """set_id and component of the sets that have a similar one within 4 bits of their SimHash."""
    links = linked(likely(_golay_candidates(leaders), leaders), leaders, rows, order)
    return written(connected_components(links, "a", "b").withColumnRenamed("node", "set_id"), "simhash-groups")


def _grouped(docs: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Prints of all rows, and for each set its digest, first row and count of rows, and its component's first row (least)."""
    rows = docs.select(*keys(), "text")
    order = docs.sparkSession.sparkContext.broadcast(global_order(rows))
    prints, leaders = distinct_sets(rows, order, majority)
    groups = set_groups(rows, leaders, order, simhash_groups(rows, leaders, order), bucket_rows)
    named = written(leaders.select("set_id", "digest", *KEY, "rows").join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "named-sets")
    least = named.groupBy("component").agg(F.min(F.struct(*KEY)).alias("least"))
    return prints, written(named.join(least, "component").select("digest", *KEY, "rows", "least"), "near-groups")


def near_copy_components(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, component_id of each row: the smallest doc_id reachable through near copies.

    Texts without words are copies of each other. Rows with a null id take part; their group's component_id is null
    only where no row of it has an id. No rows give no rows; other columns are ignored.
    """
    prints, named = _grouped(docs, bucket_rows)
    facts = named.select("digest", F.when(~F.col("least.no_id"), F.col("least.id")).alias("component_id"), "rows")
    out = join_facts(prints.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "digest"), facts, "digest", "rows")
    return out.select("doc_id", "component_id")


def keep_one_copy(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id. Columns stay.

    Rows with a null id take part, and stay only if their group has no row with one. Of repeated rows (the same id and
    text) one stays. Two texts under one id are two documents.
    """
    _, named = _grouped(docs, bucket_rows)
    same = F.expr(" and ".join(f"{k} = least.{k}" for k in KEY))
    own = [f"__{k}" for k in KEY]
    first = named.where(same).select(*[F.col(k).alias(o) for k, o in zip(KEY, own)]).distinct()
    rows = docs.withColumns(dict(zip(own, keys()))).dropDuplicates(own)
    return rows.join(first, own, "left_semi").select(docs.columns)
