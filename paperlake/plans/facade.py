"""One object for the usual questions; every method returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, graph, linking, profiles, search, traverse
from ..operators.resolve import resolve_entity_names

__all__ = ["Library"]


@dataclass
class Library:
    """A graph (nodes, edges) of one workspace, with vectors if there are any."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, workspace: str = "default") -> Library:
        """A stored graph: ``nodes`` and ``edges`` below ``path``."""
        nodes, edges = (profiles.workspace_scope(spark.read.parquet(f"{path}/{t}"), workspace) for t in ("nodes", "edges"))
        return cls(nodes, edges)

    def save(self, path: str) -> None:
        """Nodes, and edges by type."""
        self.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles.paper_profiles(self.nodes, self.edges)

    def _table(self, name: str, *values: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")

    def papers(self) -> DataFrame:
        return profiles.list_papers(self.nodes)

    def papers_by_method(self, *queries: str, fuzzy: bool = True) -> DataFrame:
        return self._by("USES", "method", queries, fuzzy)

    def papers_by_task(self, *queries: str) -> DataFrame:
        return self._by("TARGETS", "task", queries, True)

    def _by(self, edge: str, kind: str, queries: tuple[str, ...], fuzzy: bool) -> DataFrame:
        asked = self._table("query", *queries)
        if not fuzzy:
            return profiles.find_papers_by_entity(self.nodes, self.edges, asked, edge)
        catalog = self.nodes.filter(F.lower("type") == kind).select(F.lit(kind).alias("entity_type"), "name").distinct()
        names = resolve_entity_names(asked.select(F.lit(kind).alias("entity_type"), F.col("query").alias("name")), catalog)
        return profiles.resolved_papers_by_entity(self.nodes, self.edges, names.select(F.col("name").alias("query"), "canonical"), edge)

    def paper(self, *ids: str) -> DataFrame:
        return self.profiles.join(self._table("paper_id", *ids), "paper_id", "left_semi")

    def summaries(self) -> DataFrame:
        return profiles.summarize_papers(self.profiles)

    def limitations(self, topic: str = "") -> DataFrame:
        return profiles.find_limitations(self.nodes, self.edges, topic)

    def claims(self) -> DataFrame:
        return profiles.claim_evidence(self.nodes, self.edges)

    def compare(self, *ids: str) -> DataFrame:
        return compare.comparison_rows(self.paper(*ids))

    def missing(self, *ids: str) -> DataFrame:
        return linking.missing_ids(self._table("paper_id", *ids), self.papers())

    def matrix(self, topic: str) -> DataFrame:
        return compare.literature_matrix(self.profiles, topic)

    def outline(self, topic: str) -> DataFrame:
        return compare.related_work_outline(self.profiles, topic)

    def gaps(self, topic: str, min_papers: int = 1) -> DataFrame:
        """Items are taken in order of paper and limitation."""
        rows = self.limitations(topic).withColumn("item_ord", F.xxhash64("paper_id", "limitation", "page", "section"))
        return compare.research_gaps(rows, topic, min_papers)

    def neighbors(self, *ids: str) -> DataFrame:
        return traverse.paper_neighbors(self.edges, self._table("paper_id", *ids), nodes=self.nodes)

    def expand(self, *ids: str, hops: int = 2) -> DataFrame:
        names = self.nodes.filter("type = 'Method'").select("id", "name")
        return traverse.explore_graph(self.edges, self._table("paper_id", *ids), hops, names)

    def search(self, query: str, top_k: int = 10, center: str | None = None, vector: list[float] | None = None) -> DataFrame:
        asked = self._table("query", query.strip())
        channels = [search.entity_channel(self.papers_by_method(query.strip())), search.entity_channel(self.papers_by_task(query.strip())), search.matrix_channel(self.profiles, asked), search.keyword_channel(self.profiles, asked)]
        if vector is not None and self.vectors is not None:
            channels.append(search.embedding_channel(self.vectors, asked.withColumn("vector", F.array(*map(F.lit, vector)))))
        boosts = None
        if center:
            expanded = traverse.expand_graph(self.edges, self._table("paper_id", center), 2)
            boosts = search.graph_distance_boost(expanded).withColumn("query", F.lit(query.strip()))
        return search.hybrid_search(self.profiles, channels, top_k, boosts)

    def suggestions(self, *ids: str) -> DataFrame:
        return linking.did_you_mean(self._table("query", *ids), self.papers().withColumn("source_path", F.lit(None).cast("string")))

    def stats(self) -> DataFrame:
        return graph.build_stats(self.nodes, self.edges)

    def viewer(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.viewer_payload(self.nodes, self.edges)
